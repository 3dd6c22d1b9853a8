"""DuckDB SQL of the queries that it can express: rules over words, lines and strings, and all windows, pairs and byte strings as rows."""

# fixed values: white space between words, and the windows' length as in ``quality``
_BLANK = r"[ \t\n\x0B\f\r]"

CASCADE = rf"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
cut as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '{_BLANK}'), lambda x: x <> '') as w,
 list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_BLANK}', '', 'g')) > 0) as l from docs),
wins as (select r, i, list_slice(w, i, i + 7) as win from (select r, w, unnest(range(1, len(w) - 6)) as i from cut where len(w) > 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, win) as n from wins) where n > 1),
steps as (select r, least(8, coalesce(lead(i) over (partition by r order by i) - i, 8)) as step from twice),
covered as (select r, sum(step) as n from steps group by r),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '{_BLANK}', '', 'g')) as bigint) as word_chars,
 cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
 cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
 length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) as n_upper,
 len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutter from cut left join covered using (r)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not (base_failed or 100 * n_symbols > 25 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines)
 or 100 * n_stutter > 20 * n_words or 100 * n_upper > 30 * word_chars) as kept from judged"""

# a turn's text is at odds with the grammar if it ends a turn early or holds an escape; the role's bytes are percent-encoded, a space as +
CHAT = r"""with turns as (select conv_id, cast(turn as bigint) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) as o(conv_id, turn, role, text)),
seen as (select *, contains(text, '[/INST]</s>') or regexp_matches(text, '([<\[])(\\*)\\(/?(?:s>|INST\]))') as odd,
 len(regexp_extract_all(text, '([<\[])(\\*)(/?(?:s>|INST\]))')) as marks,
 9 + length(url_encode(translate(role, ' *', '++'))) - 2 * len(regexp_extract_all(role, '[ *]')) + 2 * len(regexp_extract_all(role, '~')) + 1 + length(text) + 11 as chars from turns),
told as (select conv_id, bool_or(odd) as escaped, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as told,
 coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss, sum(chars) as chars, sum(marks) as marks from seen group by conv_id)
select conv_id, n_turns, sha256(told) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
 cast(chars + case when escaped then marks else 0 end as bigint) as formatted_chars, escaped from told"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

ANCHORS = rf"""with d as (select doc_id, {_WORDS} as w from documents),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
wins as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
hits as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by md5(win)) as first from wins) where first < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from hits),
removed as (select doc_id, count(*) as n from gone group by all),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from words anti join gone using (doc_id, i) group by all)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join removed using (doc_id) left join kept using (doc_id)"""

# a word's place: what stands before it are words and runs of what is no word character
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NO_WORD = r"\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}"

AUTOMATON = rf"""with d as (select doc_id, {_LOW} as t from documents),
dw as (select *, regexp_extract_all(t, '[^{_NO_WORD}]+') as w, regexp_extract_all(t, '[{_NO_WORD}]+') as gaps, cast(regexp_matches(t, '^[{_NO_WORD}]') as int) as lead from d),
items as (select item_id, regexp_extract_all({_LOW}, '[^{_NO_WORD}]+') as w from benchmark where item_id is not null),
pats as (select distinct item_id, win, len(win) as n from (select item_id, w[i:i + least(10, len(w)) - 1] as win from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0))),
sizes as (select distinct n from pats),
wins as (select doc_id, i, n, w[i:i + n - 1] as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
hits as (select doc_id, i, wins.n as n, item_id from wins join pats using (win)),
hit as (select distinct doc_id, unnest(range(i, i + n)) as i from hits),
runs as (select doc_id, min(i) as a, max(i) as b from (select doc_id, i, i - row_number() over (partition by doc_id order by i) as g from hit) group by doc_id, g),
places as (select r.doc_id, sum(len(array_to_string(w[a:b], '')) + len(array_to_string(gaps[a + lead:b - 1 + lead], ''))) as chars, count(*) as n from runs r join dw using (doc_id) group by all),
n_hits as (select doc_id, count(*) as n from hit group by all),
who as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by all)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(h.n, 0) as bigint) as n_hit, cast(coalesce(who.n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated,
 cast(coalesce(p.n, 0) as bigint) as n_spans, cast(coalesce(chars, 0) as bigint) as span_chars from dw left join n_hits h using (doc_id) left join who using (doc_id) left join places p using (doc_id)"""

FOREST = rf"""with recursive d as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
nodes as (select md5(t) as node, any_value(w) as w, min(doc_id) as least, count(*) as n from d group by all),
shingles as (select distinct node, md5(array_to_string(w[i:i + 4], ' ')) as s from (select node, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from nodes where len(w) > 0)),
sizes as (select node, count(*) as k from shingles group by all),
pairs as (select a.node as x, b.node as y, count(*) as shared from shingles a join shingles b on a.s = b.s and a.node <> b.node group by all),
links as (select x, y from pairs join sizes p on p.node = x join sizes q on q.node = y where 5 * shared >= 4 * (p.k + q.k - shared)),
reach as (select node as x, node as y from nodes union select r.x, l.y from reach r join links l on r.y = l.x),
classes as (select r.x as node, min(m.least) as class_id from reach r join nodes m on m.node = r.y group by all),
degree as (select l.x as node, sum(m.n) as n from links l join nodes m on m.node = l.y group by all)
select doc_id, class_id, cast(copies + coalesce(degree.n, 0) - 1 as bigint) as n_links from (select doc_id, md5(t) as node from d) join (select node, n as copies from nodes) using (node) join classes using (node) left join degree using (node)"""

# bytes as pairs of hexadecimal digits; a window is cut from a block of twice its length, so no cut walks through a long text
REPEATED_BYTES = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
blocks as (select doc_id, b, len(h) // 2 as n, substr(h, 800 * b + 1, 1600) as block from (select doc_id, h, unnest(range(0, len(h) // 800 + 1)) as b from d where len(h) >= 800)),
wins as (select doc_id, i, md5(substr(block, 2 * j + 1, 800)) as k from (select doc_id, block, n, 400 * b + j as i, j from blocks, range(0, 400) as r(j)) where i + 400 <= n),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as n from wins) where n > 1),
edges as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i), -401) + 400 as new from twice),
spans as (select doc_id, s, min(i) as a, max(i) + 400 as b from (select doc_id, i, sum(cast(new as int)) over (partition by doc_id order by i) as s from edges) group by all),
gaps as (select doc_id, b as x, coalesce(lead(a) over (partition by doc_id order by a), 1000000000) as y from spans union all select doc_id, 0, min(a) from spans group by doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as t from gaps join d using (doc_id) group by all),
removed as (select doc_id, sum(b - a) as n, count(*) as k from spans group by all)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, cast(coalesce(k, 0) as bigint) as n_spans, sha256(unhex(coalesce(t, h))) as kept_sha256
 from d left join removed using (doc_id) left join kept using (doc_id)"""
