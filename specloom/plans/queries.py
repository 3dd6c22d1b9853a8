"""Registered queries of the manual engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions import text as X
from specloom.operators import answers, chunks, context, procedures, retrieval, segments, specs, structure
from specloom.plans import manual

FLAT = ["doc_id", "text", "content_type", "section_id", "section_name", "subsection_type", "page_number", "line_number", "component", "value_nm", "value_lbft", "value_lbin", "value_mm", "variants", "stage_number", "is_safety_critical", "has_condition", "confidence"]
FLAT_SQL = "doc_id, text, content_type, section_id, section_name, subsection_type, page_number, line_number, component, value_nm, value_lbft, value_lbin, value_mm, array_to_string(vehicle_variant, ',') as variants, stage_number, is_safety_critical, has_condition, cast(confidence as double) as confidence"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame, *more: str) -> DataFrame:
    sv = [F.col(f"spec_value.{n}").alias(n) for n in ("value_nm", "value_lbft", "value_lbin", "value_mm")]
    df = df.select("*", *sv, F.array_join("vehicle_variant", ",").alias("variants"))
    return df.select(*FLAT, *more)


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def from_ctes(select: str) -> str:
    return f"{manual.ctes()} {select}"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.parse(manual.documents(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.all_segments(_lines(spark, sf_dir))


# ---- cleaning ----

DIRT = "   “q”  \t  x–y http://a.b/c file:///tmp/f\n\n\n\n\n2014 F-150 Workshop Manual  Page 3 sur 9  \nProcedure revision date: 1/2/2014 \nSECTION 204-01: Name 2014-03-01 \nend\x01\x7f "


def _dirt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.col("n_name"), F.lit(DIRT), F.col("n_name"), F.lit(" \n ")).alias("text"))


def _sql_clean(c: str, generic: bool = False) -> str:
    sub = lambda t, p, r="''": f"regexp_replace({t}, {manual._q(p)}, {r}, 'g')"
    c = sub(c, P.CONTROL.replace(r"\x7f-\x9f", r"\x{7f}-\x{9f}"))
    c = sub(c, P.ANY_URL) if generic else sub(sub(sub(sub(c, P.FILE_URL), P.PAGE_STAMP), P.REVISION_DATE), P.SECTION_DATE, r"'\1' || chr(10)")
    c = sub(sub(c, P.MANY_SPACES, "' '"), P.MANY_LINES, "chr(10) || chr(10) || chr(10)")
    c = f"translate({c}, '’‘“”', '''''\"\"')"
    c = f"translate({c}, '–—', '--')" if generic else f"replace({c}, '–', '—')"
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


_SQL_DIRT = "n_name || " + " || ".join(f"chr({ord(ch)})" if ord(ch) < 32 or ord(ch) > 126 or ch == "'" else f"'{ch}'" for ch in DIRT) + " || n_name || ' ' || chr(10) || ' '"


@query(f"select n_nationkey, {_sql_clean('t')} as workshop, {_sql_clean('t', True)} as generic from (select n_nationkey, {_SQL_DIRT} as t from nation)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both dialects' cleaning of a text with every kind of dirt."""
    return _dirt(spark, sf_dir).select("n_nationkey", X.clean(F.col("text")).alias("workshop"), X.clean(F.col("text"), P.GENERIC).alias("generic"))


@query("select doc_id, n_chars, round(100.0 * length(t) / n_chars, 1) as retention from (select doc_id, length(text) as n_chars, " + _sql_clean("text") + " as t from documents where length(text) > 0)")
def clean_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of each document's characters that cleaning keeps."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").filter(F.length(t) > 0).select("doc_id", F.length(t).cast("long").alias("n_chars"), X.retention(t, X.clean(t)).alias("retention"))


# ---- structure and specs ----


@query(from_ctes("select doc_id, idx, text, content_type, section_id, section_name, subsection_type, page_number from typed"))
def classified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lines with section, subsection and page filled forward."""
    return _lines(spark, sf_dir)


@query(from_ctes(f"select {FLAT_SQL} from rows1 where one"))
def torque_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-line rows of torque tables."""
    return flat(specs.table_rows(_lines(spark, sf_dir)).filter("confidence = 0.98"))


@query(from_ctes(f"select {FLAT_SQL} from rows1 where not one"))
def stacked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of torque tables whose values stand on the three lines after."""
    return flat(specs.table_rows(_lines(spark, sf_dir)).filter("confidence = 0.96"))


@query(from_ctes(f"select {FLAT_SQL} from stage"))
def staged_torque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'Stage n: …' torques."""
    return flat(specs.staged_torques(_lines(spark, sf_dir)))


@query(from_ctes(f"select {FLAT_SQL} from torque"))
def inline_torque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Torques inside procedure text."""
    return flat(specs.inline_torques(_lines(spark, sf_dir)))


@query(from_ctes(f"select {FLAT_SQL} from dims"))
def dimension_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths inside procedure text."""
    return flat(specs.dimensions(_lines(spark, sf_dir)))


@query(from_ctes(f"select {FLAT_SQL} from blk"))
def procedure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with their continuation lines."""
    return flat(procedures.blocks(_lines(spark, sf_dir)))


@query(from_ctes(f"select {FLAT_SQL}, seg_seq from segs"))
def all_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments in list order."""
    return flat(_segments(spark, sf_dir), "seg_seq")


@query(from_ctes(f"select {FLAT_SQL}, seg_seq from dedup"))
def spec_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs, one for each component, Nm and section."""
    return flat(segments.deduplicated(_segments(spark, sf_dir)), "seg_seq")


@query(from_ctes("select content_type, count(*) as n from dedup group by all"))
def specs_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.count_by_type(segments.deduplicated(_segments(spark, sf_dir)))


@query(from_ctes("select section_id, section_name, count(*) as n from dedup group by all order by n desc, section_id, section_name limit 10"))
def top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sections with most specs."""
    return segments.top_sections(segments.deduplicated(_segments(spark, sf_dir)))


@query(from_ctes("select doc_id, count(distinct nullif(trim(lower(component)), '')) as components from dedup group by doc_id"))
def unique_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.unique_components(segments.deduplicated(_segments(spark, sf_dir)))


@query(from_ctes("select s.doc_id, s.total_segments, s.procedure_segments, s.torque_rows, d.spec_segments from (select doc_id, count(*) as total_segments, count(*) filter (content_type = 'procedure_step') as procedure_segments, count(*) filter (content_type = 'torque_table_row') as torque_rows from segs group by doc_id) s join (select doc_id, count(*) as spec_segments from dedup group by doc_id) d using (doc_id)"))
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = manual.documents(spark, sf_dir)
    every, kept = segments.extract(docs)
    return segments.document_counts(docs, every, kept).drop("raw_chars", "cleaned_chars", "retention")


_PARAS = "string_split(text, chr(10))"


@query(
    "select doc_id, 'para_' || (i - 1) as section_id, t as text from (select doc_id, unnest(p[:100]) as t, generate_subscripts(p[:100], 1) as i from "
    f"(select doc_id, list_filter(list_transform({_PARAS}, lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') as p from documents))"
)
def paragraph_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs (here: lines) of documents without specs, the first hundred of each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return procedures.paragraphs(docs).select("doc_id", "section_id", "text")


# ---- chunk splitting ----

_SENTENCES = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_PACK = """list_reduce(list_transform(%s, lambda s: {'done': cast([] as varchar[]), 'buf': s}), lambda a, x:
 case when length(a.buf) + length(x.buf) < 400 then {'done': a.done, 'buf': trim(a.buf || ' ' || x.buf)}
 else {'done': case when a.buf = '' then a.done else list_append(a.done, a.buf) end, 'buf': x.buf} end,
 {'done': cast([] as varchar[]), 'buf': ''})"""


@query(f"select doc_id, unnest(p) as piece, generate_subscripts(p, 1) - 1 as k from (select doc_id, case when s.buf <> '' then list_append(s.done, s.buf) else s.done end as p from (select doc_id, {_PACK % _SENTENCES} as s from documents))")
def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed into pieces of under 400 characters where they fit."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.pack_sentences(F.col("text"))).alias("k", "piece")).withColumn("k", F.col("k").cast("long"))


@query(
    """with recursive cut as (select doc_id, 0 as k, '' as piece, text as rest, true as going from documents
 union all select doc_id, k + 1, case when length(rest) > 400 then trim(substr(rest, 1, cut_at)) else rest end, case when length(rest) > 400 then regexp_replace(regexp_replace(substr(rest, cut_at + 1), '^\\s+', ''), '\\s+$', '') else '' end, length(rest) > 400
 from (select *, case when instr(substr(rest, 1, 400), ' ') > 0 then length(substr(rest, 1, 400)) - instr(reverse(substr(rest, 1, 400)), ' ') else 400 end as cut_at from cut where going))
 select doc_id, k - 1 as k, piece from (select doc_id, k, regexp_replace(regexp_replace(piece, '^\\s+', ''), '\\s+$', '') as piece from cut where k > 0) where piece <> '' or k = 1"""
)
def hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at the last space before each 400 characters."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.hard_split(F.col("text"))).alias("k", "piece"))


# ---- context ----


@query(
    from_ctes(
        """select doc_id, line_number, seg_seq, hint from (select b.doc_id, b.line_number, b.seg_seq, r.component as hint,
 row_number() over (partition by b.doc_id, b.line_number, b.seg_seq order by abs(b.value_nm - r.value_nm) / greatest(r.value_nm, 1), abs(r.line_number - b.line_number), r.seg_seq) as n
 from dedup b join dedup r on b.doc_id = r.doc_id and b.section_id = r.section_id and trim(r.component) <> '' and r.content_type = 'torque_table_row' and r.value_nm <> 0
 and abs(b.value_nm - r.value_nm) / greatest(r.value_nm, 1) <= 0.05 where trim(b.component) = '' and b.line_number <> 0 and b.value_nm is not null) where n = 1"""
    )
)
def value_match_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unnamed specs with the name of the section's table row of about the same value."""
    return context.value_match(segments.deduplicated(_segments(spark, sf_dir)))


@query(
    from_ctes(
        """select s.doc_id, s.seg_seq, n.near from segs s left join lateral (select trim(component) as near from segs x where x.doc_id = s.doc_id and x.line_number between s.line_number - 30 and s.line_number - 1
 and trim(x.component) <> '' order by x.line_number desc, x.seg_seq limit 1) n on true"""
    )
)
def nearest_component_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest named segment in the 30 lines before each segment."""
    return context.nearest_component(_segments(spark, sf_dir)).select("doc_id", "seg_seq", "near")


_V, _PH = manual.re("text", P.TRIM, 1), manual.re("text", P.PHRASE, 1)


@query(
    from_ctes(
        f"""select s.doc_id, s.seg_seq, b.line as before_line, b.variant as before_variant, b.phrase as before_phrase, a.line as after_line, a.variant as after_variant from segs s
 left join lateral (select line_number as line, v as variant, p as phrase from (select *, nullif({_V}, '') as v, nullif(trim({_PH}), '') as p from segs) x where x.doc_id = s.doc_id and x.line_number between s.line_number - 150 and s.line_number - 1 and v is not null
  order by x.line_number desc, p is not null desc, x.seg_seq limit 1) b on true
 left join lateral (select line_number as line, v as variant from (select *, nullif({_V}, '') as v from segs) x where x.doc_id = s.doc_id and x.line_number between s.line_number + 1 and s.line_number + 40 and v is not null
  order by x.line_number, x.seg_seq limit 1) a on true"""
    )
)
def variant_scan_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trim names and phrases in the 150 lines before and the 40 after each segment."""
    found = context.variant_scan(_segments(spark, sf_dir))
    return found.select("doc_id", "seg_seq", F.col("before.line").alias("before_line"), F.col("before.variant").alias("before_variant"), F.col("before.phrase").alias("before_phrase"), F.col("after.line").alias("after_line"), F.col("after.variant").alias("after_variant"))


# ---- enrichment ----

_SPEC_PREFIX = "concat_ws(' | ', case when section_name <> '' then 'Section: ' || section_name end, case when len(vehicle_variant) > 0 then 'Variant: ' || array_to_string(vehicle_variant, ', ') end, case when subsection_type <> '' then 'Context: ' || subsection_type end, case when comp <> '' then 'Component: ' || comp end)"
_INSIDE = f"trim({manual.re('comp', P.PARENTHESIS, 1)})"
_BARE = "trim(regexp_replace(comp, '\\s*\\([^)]+\\)\\s*$', ''))"
_BODY = "case when comp <> '' and starts_with(text, 'Component:') then regexp_replace(text, '^Component:\\s*[^—]+—\\s*', '') else text end"
_LOUD = f"case when {_INSIDE} <> '' then {_INSIDE} || ' | ' || {_INSIDE} || ' ' || {_BARE} || ' | ' || {_SPEC_PREFIX} when contains(comp, 'SVT Raptor') or contains(text, 'SVT Raptor') then 'SVT Raptor | SVT Raptor | ' || {_SPEC_PREFIX} else {_SPEC_PREFIX} end"
_ENRICH_SQL = f"""case when content_type = 'procedure_step' then case when {_V} <> '' or section_name <> '' then trim(concat_ws(' | ', nullif({_V}, ''), case when section_name <> '' then '[' || section_name || ']' end) || ' ' || text) else text end
 else {_LOUD} || ' | ' || {_BODY} end"""
# components of every third spec get a tag, so that the parenthesis rule is met
_TAGGED = "case when content_type <> 'procedure_step' and seg_seq % 3 = 0 and trim(component) <> '' then component || ' (SVT Raptor)' else component end"


@query(from_ctes(f"select doc_id, seg_seq, {_ENRICH_SQL} as embed_text from (select *, {_TAGGED} as comp from segs)"))
def enriched_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedded text of every segment."""
    seg = _segments(spark, sf_dir)
    tag = (F.col("content_type") != "procedure_step") & (F.col("seg_seq") % 3 == 0) & (F.btrim("component") != "")
    seg = seg.withColumn("component", F.when(tag, F.concat("component", F.lit(" (SVT Raptor)"))).otherwise(F.col("component")))
    return seg.select("doc_id", "seg_seq", chunks.enriched(X.strip(F.col("component"))).alias("embed_text"))


@query(from_ctes(f"select 'spec' as chunk_type, count(*) as chunks, floor(avg(length(t))) as avg_chars, max(length(t)) as max_chars from (select {_ENRICH_SQL} as t from (select *, component as comp from dedup))"))
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and lengths of spec chunks without hints."""
    kept = segments.deduplicated(_segments(spark, sf_dir))
    none = kept.select("doc_id", "line_number").limit(0).withColumn("hint", F.lit(""))
    return segments.length_stats(chunks.spec_chunks(kept, none)).withColumn("avg_chars", F.col("avg_chars").cast("double"))


# ---- retrieval over documents and embeddings ----

QUESTIONS = ["the of and in to thand", "ererea of in of in", "que la de des", "torque for nothing", "zzzz qqqq"]
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))
_K = 20
_QUERY_SQL = f"queries as (select * from (values {_VALUES}) as t(query_id, query))"
_TOKS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
_BM25 = f"""{_QUERY_SQL}, toks as (select lang as index_key, doc_id as chunk_pos, {_TOKS.format(c="text")} as toks from documents),
lens as (select index_key, chunk_pos, len(toks) as dl from toks), stats as (select index_key, count(*) as n, avg(dl) as avgdl from lens group by 1),
post as (select index_key, chunk_pos, term, count(*) as tf from (select index_key, chunk_pos, unnest(toks) as term from toks) group by all),
raws as (select index_key, term, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select index_key, term, count(*) as df from post group by all) join stats using (index_key)),
idfs as (select index_key, term, case when raw < 0 then 0.25 * avg(raw) over (partition by index_key) else raw end as idf from raws),
qt as (select query_id, term, count(*) as c from (select query_id, unnest({_TOKS.format(c="query")}) as term from queries) group by all),
hits as (select query_id, index_key, chunk_pos, round(sum(c * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from qt join idfs using (term) join post using (index_key, term) join lens using (index_key, chunk_pos) join stats using (index_key) group by all),
bm25 as (select query_id, index_key, chunk_pos, score, rank from (select query_id, index_key, chunk_pos, coalesce(score, 0) as score, cast(row_number() over (partition by query_id, index_key order by coalesce(score, 0) desc, chunk_pos desc) - 1 as int) as rank
 from (select query_id, index_key, chunk_pos from queries cross join lens) left join hits using (query_id, index_key, chunk_pos)) where rank < {_K})"""
# a document's vector is the one with its number modulo the vectors; query i takes vector 7 i + 3
_DENSE = f"""vecs as (select index_key, chunk_pos, embedding from (select lang as index_key, doc_id as chunk_pos, doc_id % (select count(*) from embeddings) as vec_id from documents) join embeddings using (vec_id)),
qvecs as (select query_id, embedding as qvec from (select query_id, query_id * 7 + 3 as vec_id from queries) join embeddings using (vec_id)),
dense as (select query_id, index_key, chunk_pos, score, rank from (select *, cast(row_number() over (partition by query_id, index_key order by score desc, chunk_pos) - 1 as int) as rank
 from (select query_id, index_key, chunk_pos, round(list_sum(list_transform(list_zip(embedding, qvec), lambda p: cast(p[1] as double) * cast(p[2] as double))), 6) as score from vecs cross join qvecs)) where rank < {_K})"""
_WITHIN = f"""within0 as (select query_id, index_key, chunk_pos, min(dr) as dr, min(sr) as sr from (select query_id, index_key, chunk_pos, rank as dr, null as sr from dense union all select query_id, index_key, chunk_pos, null, rank from bm25) group by all),
fused as (select query_id, index_key, chunk_pos, rrf_score, cast(rank0 as int) as rank from (select *, row_number() over (partition by query_id, index_key order by rrf_score desc, coalesce(dr, 1073741824), coalesce(sr, 1073741824)) - 1 as rank0
 from (select *, round(coalesce(1.0 / (61 + dr), 0.0) + coalesce(1.0 / (61 + sr), 0.0), 6) as rrf_score from within0)) where rank0 < {_K})"""
# 'spec' is the English index, 'procedure' the French one; even documents have a variant
_CROSS = """crossed as (select *, case chunk_pos % 4 when 0 then ['RWD'] when 2 then ['4WD'] else cast([] as varchar[]) end as vehicle_variant, cast(row_number() over (partition by query_id order by final_rrf desc, t, rank) - 1 as int) as place
 from (select query_id, index_key, chunk_pos, rank, 1.0 / (61 + rank) as final_rrf, case when index_key = 'en' then 0 else 1 end as t from fused where index_key in ('en', 'fr')))"""


def _queries(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select cast(query_id as int) as query_id, query from (values {_VALUES}) as t(query_id, query)")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("index_key"), F.col("doc_id").alias("chunk_pos"), "text")


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_top(retrieval.bm25_index(_documents(spark, sf_dir)), _queries(spark), _K)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    n = vectors.count()
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("index_key"), F.col("doc_id").alias("chunk_pos"), (F.col("doc_id") % n).alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id")
    asked = _queries(spark).withColumn("vec_id", F.col("query_id") * 7 + 3).join(vectors.select("vec_id", F.col("embedding").alias("qvec")), "vec_id")
    return retrieval.dense_top(docs, asked, _K)


def _within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse_within(_dense(spark, sf_dir), _sparse(spark, sf_dir), _K)


def _across(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = _within(spark, sf_dir)
    kind = F.pmod("chunk_pos", F.lit(4))
    variants = F.when(kind == 0, F.array(F.lit("RWD"))).when(kind == 2, F.array(F.lit("4WD"))).otherwise(X.no_variants())
    rows = fused.withColumn("vehicle_variant", variants)
    return retrieval.fuse_across(rows.filter("index_key = 'en'"), rows.filter("index_key = 'fr'"))


@query(f"with {_BM25} select * from bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each language for each question, by BM25."""
    return _sparse(spark, sf_dir)


@query(f"with {_QUERY_SQL}, {_DENSE} select * from dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by exact inner product."""
    return _dense(spark, sf_dir)


@query(f"with {_BM25}, {_DENSE}, {_WITHIN} select * from fused")
def rrf_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings of an index fused."""
    return _within(spark, sf_dir)


@query(f"with {_BM25}, {_DENSE}, {_WITHIN}, {_CROSS} select query_id, index_key, chunk_pos, place, round(final_rrf, 9) as final_rrf from crossed")
def rrf_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes' rankings fused by place."""
    return _across(spark, sf_dir).select("query_id", "index_key", "chunk_pos", "place", F.round("final_rrf", 9).alias("final_rrf"))


@query(
    f"with {_BM25}, {_DENSE}, {_WITHIN}, {_CROSS}, kept as (select *, cast(row_number() over (partition by query_id order by place) - 1 as int) as p, max(final_rrf) over (partition by query_id) as top from crossed where len(vehicle_variant) = 0 or list_contains(vehicle_variant, 'RWD')) "
    "select query_id, index_key, chunk_pos, p as place from kept where p < 5 and top >= 0.010"
)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused, filtered by variant after ranking, the first five, if the best is relevant."""
    kept = retrieval.keep_variant(_across(spark, sf_dir), F.lit("RWD"))
    return retrieval.first_k(retrieval.relevant(kept), 5).select("query_id", "index_key", "chunk_pos", "place")


# ---- records ----

_FAST0 = """recs as (select doc_id, seg_seq, content_type, trim(component) as component, section_id, stage_number, confidence, unnest(r) as rec, generate_subscripts(r, 1) - 1 as k from
 (select *, list_filter([case when value_nm is not null then {'v': cast(value_nm as varchar), 'u': 'Nm'} end, case when value_lbft is not null then {'v': cast(value_lbft as varchar), 'u': 'lb-ft'} end,
 case when value_lbin is not null then {'v': cast(value_lbin as varchar), 'u': 'lb-in'} end, case when value_mm is not null and coalesce(value_nm, value_lbft, value_lbin) is null then {'v': cast(value_mm as varchar), 'u': 'mm'} end], lambda x: x is not null) as r
 from dedup where trim(component) <> '' and coalesce(value_nm, value_lbft, value_lbin, value_mm) is not null))"""


def _fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = segments.deduplicated(_segments(spark, sf_dir)).withColumnRenamed("doc_id", "query_id").withColumn("place", F.col("seg_seq")).withColumn("display_text", F.col("text"))
    return answers.unpivot(kept)


@query(from_ctes(f", {_FAST0} select doc_id as query_id, component, case when rec.u = 'mm' then 'Dimension' when content_type = 'dimensional_spec' then 'Dimension' else 'Torque' end as spec_type, rec.v as value, rec.u as unit, section_id, stage_number, cast(confidence as double) as confidence from recs"))
def fast_path_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named specs as one record for each value."""
    return _fast(spark, sf_dir).select("query_id", "component", "spec_type", "value", "unit", "section_id", "stage_number", "confidence")


_CLEAN_VALUE = "case when try_cast(v as double) = floor(try_cast(v as double)) then cast(cast(try_cast(v as double) as bigint) as varchar) else v end"


@query(
    from_ctes(
        f""", {_FAST0}, seqd as (select doc_id as query_id, component, case when rec.u = 'mm' or content_type = 'dimensional_spec' then 'Dimension' else 'Torque' end as spec_type, rec.v as v0, rec.u as unit, section_id, stage_number, cast(confidence as double) as confidence, seg_seq * 1048576 + k as seq from recs),
 twice as (select *, v0 as v from seqd union all select query_id, component, spec_type, v0, unit, section_id, stage_number, confidence + case when seq % 2 = 0 then 0.01 else -0.01 end, seq + 524288, case when (seq // 1048576) % 5 = 0 then '7.0' else v0 end from seqd),
 cleaned as (select * exclude (v, v0), {_CLEAN_VALUE} as value from twice),
 wins as (select *, first_value(value) over (partition by query_id, trim(lower(component)), unit, stage_number, section_id order by seq) as fv, min(value) over (partition by query_id, trim(lower(component)), unit, stage_number, section_id) <> max(value) over (partition by query_id, trim(lower(component)), unit, stage_number, section_id) as is_conflict, min(seq) over (partition by query_id, trim(lower(component)), unit, stage_number, section_id) as fs from cleaned),
 best as (select *, row_number() over (partition by query_id, trim(lower(component)), unit, stage_number, section_id order by value = fv desc, confidence desc, seq) as n from wins)
 select query_id, cast(row_number() over (partition by query_id order by section_id, component, fs) - 1 as int) as position, component, spec_type, value, unit, section_id, stage_number, confidence, is_conflict from best where n = 1"""
    )
)
def validated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and copies with other confidences and values, validated."""
    one = _fast(spark, sf_dir)
    other = one.withColumn("confidence", F.col("confidence") + F.when(F.col("seq") % 2 == 0, 0.01).otherwise(-0.01)).withColumn("value", F.when(F.floor(F.col("seq") / answers.FAR) % 5 == 0, F.lit("7.0")).otherwise(F.col("value"))).withColumn("seq", F.col("seq") + answers.FAR // 2)
    got = answers.validate(one.unionByName(other))
    return got.select("query_id", "position", "component", "spec_type", "value", "unit", "section_id", "stage_number", "confidence", "is_conflict")


_LOW = "trim(regexp_extract(replace({c}, ',', ''), '^[^-–]*', 0))"
_UNIT_SQL = "case when contains(lower({c}), 'kgf') then 'kgf·cm' when contains(lower({c}), 'ft') then 'lb-ft' else 'lb-in' end"
_FALLBACK = f"""lns as (select doc_id as query_id, 'what is the torque for part ' || doc_id || ' torque' as query, seg_seq as place, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ln from segs where content_type = 'procedure_step'),
ms as (select *, unnest(regexp_extract_all(line, {manual._q(P.FALLBACK_TORQUE)}, 0)) as m, generate_subscripts(regexp_extract_all(line, {manual._q(P.FALLBACK_TORQUE)}, 0), 1) - 1 as k from lns where {manual.is_("line", P.FALLBACK_TORQUE)}),
ls as (select *, unnest(regexp_extract_all(line, {manual._q(P.FALLBACK_LBFT)}, 0)) as m, generate_subscripts(regexp_extract_all(line, {manual._q(P.FALLBACK_LBFT)}, 0), 1) - 1 as k from lns where not {manual.is_("line", P.FALLBACK_TORQUE)}),
vals as (select query_id, query, place, ln, k, {_LOW.format(c=manual.re("m", P.FALLBACK_TORQUE, 1))} as value, 'Nm' as unit, 0.65 as confidence, {_LOW.format(c=manual.re("m", P.FALLBACK_TORQUE, 3))} as imp, {_UNIT_SQL.format(c=manual.re("m", P.FALLBACK_TORQUE, 4))} as imp_unit from ms
 union all select query_id, query, place, ln, k, {_LOW.format(c=manual.re("m", P.FALLBACK_LBFT, 1))}, 'lb-ft', 0.60, '', '' from ls),
firsts as (select * from (select *, row_number() over (partition by query_id, unit, round_even(try_cast(value as double), 0) order by place, ln, k) as n from vals where try_cast(value as double) > 0) where n = 1),
imps as (select * from (select query_id, query, place, ln, k, imp as value, imp_unit as unit, confidence, row_number() over (partition by query_id, imp_unit, imp order by place, ln, k) as n from firsts where imp <> '') where n = 1)"""


@query(
    from_ctes(
        f", {_FALLBACK} select query_id, 'the torque for part ' || query_id as component, value, unit, cast(confidence as double) as confidence from firsts union all select query_id, 'the torque for part ' || query_id, value, unit, cast(confidence as double) from imps"
    )
)
def regex_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Torques read from procedure text, for a question per document."""
    seg = _segments(spark, sf_dir).filter("content_type = 'procedure_step'")
    asked = seg.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("what is the torque for part "), F.col("doc_id").cast("string"), F.lit(" torque")).alias("query"), F.col("seg_seq").alias("place"), "section_id", "section_name", F.col("text").alias("display_text"))
    return answers.fallback(asked).select("query_id", "component", "value", "unit", "confidence")


# ---- the generic dialect: the oracle is the generator's own columns ----

_GEN_SQL = """select n_regionkey as doc_id, n_nationkey as sec, 0 as pos, 'AB-' || cast(n_nationkey as string) || '  TITLE ' || n_name as line from nation
union all select n_regionkey, n_nationkey, 1, 'Part tightened N·m kgf·cm ft·lbf' from nation
union all select n_regionkey, n_nationkey, 10 + p_partkey, p_name || ' nuts ' || case when p_partkey % 7 = 0 then '-' else cast(p_size as string) end || ' ' || format_number(p_size * 1020, 0) || ' ' || cast(p_size + 2 as string) from part join nation on n_nationkey = p_partkey % 25
union all select n_regionkey, n_nationkey, 5000000, 'REMOVAL AND INSTALLATION' from nation
union all select n_regionkey, n_nationkey, 6000000 + p_partkey, case p_partkey % 3 when 0 then 'When cold tighten to ' || cast(p_size as string) || ' N·m (' || format_number(p_size * 1020, 0) || ' kgf·cm, ' || cast(p_size + 2 as string) || ' ft·lbf).'
 when 1 then 'Stage 2: turn the ' || p_name || ' to ' || cast(p_size as string) || ' N·m.' else 'Gap of the ' || p_name || ': ' || cast(p_size as string) || '.5 mm (0.1 in).' end from part join nation on n_nationkey = p_partkey % 25"""
_GEN_NATION = "(select n.*, 'AB-' || n_nationkey as section_id, 'TITLE ' || n_name as section_name from nation n) join part on n_nationkey = p_partkey % 25"
_GEN = f"gen as (select *, cast(p_size as double) as nm, cast(p_size * 1020 as double) as kg, cast(p_size + 2 as double) as ft from {_GEN_NATION})"


def _generic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("nation", "part"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    rows = spark.sql(_GEN_SQL).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sec", "pos", "line"))).alias("l"))
    return structure.parse(rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")), P.GENERIC)


def _generic_flat(df: DataFrame) -> DataFrame:
    sv = [F.col(f"spec_value.{n}").alias(n) for n in ("value_nm", "value_kgcm", "value_lbft", "value_mm")]
    return df.select("doc_id", "content_type", "text", "section_id", "section_name", "component", *sv, "stage_number", "has_condition", "confidence")


@query(
    f"""with {_GEN} select n_regionkey as doc_id, 'torque_table_row' as content_type, 'Component: ' || p_name || ' nuts' || case when p_partkey % 7 = 0 then '' else ' — Torque: ' || cast(nm as varchar) || ' N·m' end || ' — (' || cast(kg as varchar) || ' kgf·cm) — (' || cast(ft as varchar) || ' lb-ft) — [' || section_name || ']' as text,
 section_id, section_name, p_name || ' nuts' as component, case when p_partkey % 7 <> 0 then nm end as value_nm, kg as value_kgcm, ft as value_lbft, cast(null as double) as value_mm, 0 as stage_number, false as has_condition, cast(0.97 as double) as confidence from gen"""
)
def generic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables in other units, thousands commas and dashes included."""
    return _generic_flat(specs.generic_table_rows(_generic_lines(spark, sf_dir)).filter(F.col("component").endswith(" nuts")))


@query(
    f"""with {_GEN} select n_regionkey as doc_id, case p_partkey % 3 when 0 then 'inline_torque' when 1 then 'multi_stage_torque' else 'dimensional_spec' end as content_type,
 case p_partkey % 3 when 0 then 'When cold tighten to ' || p_size || ' N·m (' || format('{{:,}}', p_size * 1020) || ' kgf·cm, ' || (p_size + 2) || ' ft·lbf).' when 1 then 'Stage 2: turn the ' || p_name || ' to ' || p_size || ' N·m.' else 'Gap of the ' || p_name || ': ' || p_size || '.5 mm (0.1 in).' end as text,
 section_id, section_name, case p_partkey % 3 when 1 then 'Stage 2: turn the ' || p_name else '' end as component, case when p_partkey % 3 < 2 then nm end as value_nm, case when p_partkey % 3 = 0 then kg end as value_kgcm, case when p_partkey % 3 = 0 then ft end as value_lbft,
 case when p_partkey % 3 = 2 then nm + 0.5 end as value_mm, case when p_partkey % 3 = 1 then 2 else 0 end as stage_number, p_partkey % 3 = 0 as has_condition, cast(case p_partkey % 3 when 0 then 0.90 when 1 then 0.95 else 0.88 end as double) as confidence from gen"""
)
def generic_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline and staged torques and lengths in other units."""
    return _generic_flat(specs.generic_inline_specs(_generic_lines(spark, sf_dir)))


@query(
    f"""with {_GEN} select n_regionkey as doc_id, p_name as component, nm as value_nm, kg as value_kgcm, p_name || ' | ' || p_size || ' | ' || format('{{:,}}', p_size * 1020) as text from gen where p_partkey % 2 = 0"""
)
def coordinate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables found by position; tables without a torque unit give none."""
    part, nation = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation")
    p = part.join(nation, F.col("n_nationkey") == F.col("p_partkey") % 25)
    head = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Part"), F.lit("Torque N·m"), F.lit("kgf·cm"))).otherwise(F.array(F.lit("Part"), F.lit("Size"), F.lit("Weight")))
    rows = F.array(head, F.array(F.col("p_name"), F.col("p_size").cast("string"), F.format_number(F.col("p_size") * 1020, 0)))
    tables = p.select(F.col("n_regionkey").alias("doc_id"), F.col("p_partkey").cast("int").alias("page"), rows.alias("rows"))
    return specs.coordinate_rows(tables).select("doc_id", "component", F.col("spec_value.value_nm").alias("value_nm"), F.col("spec_value.value_kgcm").alias("value_kgcm"), "text")


# ---- sinks and history ----


@query(from_ctes(f", {_FAST0} select component || ',' || case when rec.u = 'mm' or content_type = 'dimensional_spec' then 'Dimension' else 'Torque' end || ',' || rec.v || ',' || rec.u as line from recs"))
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four-column CSV lines of the fast path's records."""
    from specloom.sources import sinks

    return sinks.csv_lines(_fast(spark, sf_dir), sinks.COMPACT)


@query("select user_id as query_id, event_type as query, cast(event_id as bigint) as entry_id from events where contains(lower(event_type), 'cl') order by ts desc, event_id desc limit 100")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred entries of a history whose text contains a word."""
    from specloom.plans import history

    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("query"), F.col("event_id").alias("entry_id"), "ts")
    return history.page(history.search(rows, "CL"), 100).drop("ts")
