"""A synthetic manual over ``nation`` and ``part``: documents of a region's sections, in Spark and in SQL.

Their number grows with the parts, so windows over one document spread over as many tasks.

Values are whole numbers, so no engine's way of writing doubles matters. The same texts are
made by ``documents`` and, as the common table expressions ``raw`` … ``segs``, for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import patterns as P

# (place in its section, line); n: nation row, p: part row
SECTION_LINES = [
    ("0", "'SECTION 2' || lpad(cast(n_regionkey as string), 2, '0') || '-' || lpad(cast(n_nationkey as string), 2, '0') || case when n_nationkey % 2 = 0 then 'A' else '' end || ': ' || n_name || case n_nationkey % 3 when 0 then ' RWD' when 1 then ' 4WD' else '' end"),
    ("5", "'<<PAGE ' || cast(n_nationkey + 1 as string) || '>>'"),
    ("10", "'SPECIFICATIONS'"),
    ("20", "'Description Nm lb-ft lb-in'"),
    ("10000000", "'REMOVAL AND INSTALLATION'"),
    ("10000001", "'General remarks come first.'"),
]
NAME = "p_name || ' bolts ' || p_brand"
PART_LINES = [
    ("100 + p_partkey", f"{NAME} || ' ' || cast(p_size as string) || ' ' || case when p_partkey % 3 = 0 then '—' else cast(lbft as string) end || ' ' || case when p_partkey % 3 = 0 then cast(p_size * 9 as string) else '—' end", "true"),
    ("5000000 + 10 * p_partkey", "p_name || ' stacked nuts'", "p_partkey % 10 = 1"),
    ("5000001 + 10 * p_partkey", "cast(p_size as string)", "p_partkey % 10 = 1"),
    ("5000002 + 10 * p_partkey", "cast(lbft as string) || '-' || cast(lbft + 3 as string)", "p_partkey % 10 = 1"),
    ("5000003 + 10 * p_partkey", "'—'", "p_partkey % 10 = 1"),
    ("20000000 + 10 * p_partkey", f"'1. Remove the ' || {NAME} || '.'", "p_partkey % 4 = 0"),
    ("20000000 + 10 * p_partkey", "'z Tighten the nuts to ' || cast(p_size as string) || ' Nm (' || cast(lbft as string) || ' lb-ft).'", "p_partkey % 4 = 1"),
    ("20000000 + 10 * p_partkey", "'Stage 3: Tighten in a cross pattern to ' || cast(p_size as string) || ' Nm (' || cast(p_size * 9 as string) || ' lb-in).'", "p_partkey % 4 = 2"),
    ("20000000 + 10 * p_partkey", "'NOTICE: Do not tighten the lower shock nut on SVT Raptor.'", "p_partkey % 4 = 3"),
    ("20000001 + 10 * p_partkey", "'z Measure the ' || p_name || ' length when cold: ' || cast(p_size as string) || '.5 mm (0.' || cast(p_size as string) || ' in).'", "p_partkey % 8 = 1"),
    ("20000002 + 10 * p_partkey", "'z First to ' || cast(p_size as string) || ' Nm (' || cast(lbft as string) || ' lb-ft), then by far later, once all others are seated and all is checked, to ' || cast(p_size + 1 as string) || ' Nm (9 lb-in).'", "p_partkey % 16 = 5"),
    ("20000003 + 10 * p_partkey", "'The ride height matters here.'", "p_partkey % 6 = 1"),
]


def lines_sql(string: str = "string", div: str = "cast(floor(p_size * 738 / 1000) as int)") -> str:
    """SQL of (doc_id, sec, pos, line) over views nation and part: a region's parts, four hundred numbers to a document."""
    doc = "cast(n_regionkey + 5 * floor(p_partkey / 400) as int) as doc_id"
    parts = [f"select doc_id, n_nationkey as sec, {pos} as pos, {line} as line from heads" for pos, line in SECTION_LINES]
    parts += [f"select doc_id, n_nationkey as sec, {pos} as pos, {line} as line from fitted where {where}" for pos, line, where in PART_LINES]
    both = "part p join nation n on n.n_nationkey = p.p_partkey % 25"
    fitted = f"select n.*, p.*, {doc}, {div} as lbft from {both}"
    return f"with fitted as ({fitted}), heads as (select distinct n.*, {doc} from {both}) " + " union all ".join(parts).replace(" as string", f" as {string}")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("nation", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(lines_sql())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each document's lines joined."""
    rows = raw_lines(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sec", "pos", "line"))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re(column: str, pattern: str, group: int) -> str:
    return f"regexp_extract({column}, {_q(pattern)}, {group})"


def is_(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


def sql_number(c: str) -> str:
    low = f"coalesce(nullif({re(f'trim({c})', P.RANGE, 1)}, ''), trim({c}))"
    return f"case when regexp_full_match({low}, '[0-9.]+') then try_cast({low} as double) end"


def _between(c: str) -> str:
    """The words before 'to n Nm', as a component."""
    bare = f"regexp_replace(trim({c}), {_q(P.LINE_MARK)}, '')"
    found = f"trim({re(bare, P.BEFORE_TO, 1)})"
    return f"case when {is_(found, P.VERB_FIRST)} then '' else substr({found}, 1, 80) end"


def _text(nm: str, ft: str, lb: str) -> str:
    said = [f"'Component: ' || comp", f"'Torque: ' || cast({nm} as varchar) || ' Nm'", f"'(' || cast({ft} as varchar) || ' lb-ft)'", f"'(' || cast({lb} as varchar) || ' lb-in)'", "case when h_name <> '' then '[' || h_name || ']' end"]
    return f"concat_ws(' — ', {', '.join(said)})"


_VARIANTS = "list_filter([case when contains({c}, 'RWD') or contains({c}, 'Rear Wheel') then 'RWD' end, case when contains({c}, '4WD') or contains({c}, 'Four Wheel') then '4WD' end], lambda x: x is not null)"
_LINE_VARIANTS = "list_filter([case when contains(lower({c}), 'svt raptor') then 'SVT Raptor' end, case when contains(lower({c}), 'rwd') then 'RWD' end, case when contains(lower({c}), '4wd') then '4WD' end, case when contains(lower({c}), 'all model') then 'All' end], lambda x: x is not null)"


def ctes() -> str:
    """DuckDB: raw (lines), typed (lines with places), rows1 (table rows), inl (inline), blk (blocks), segs (all, numbered)."""
    raw = lines_sql("varchar", "p_size * 738 // 1000")
    where = "partition by doc_id order by idx rows between unbounded preceding and current row"
    return f"""with numbered as (select doc_id, cast(row_number() over (partition by doc_id order by sec, pos, line) - 1 as int) as idx, trim(line) as text from ({raw})),
marked as (select *, case when {is_("text", P.PAGE)} then cast({re("text", P.PAGE, 1)} as int) end as pg,
  {is_("text", P.SECTION)} as is_sec, {is_("text", P.SUBSECTION)} as is_sub from numbered),
filled as (select *, last_value(case when is_sec then trim({re("text", P.SECTION, 1)}) end ignore nulls) over ({where}) as sid,
  last_value(case when is_sec then trim({re("text", P.SECTION, 2)}) end ignore nulls) over ({where}) as sname,
  last_value(case when is_sec then '' when is_sub then upper({re("text", P.SUBSECTION, 1)}) end ignore nulls) over ({where}) as sub,
  last_value(pg ignore nulls) over ({where}) as page from marked),
typed as (select doc_id, idx, text, case when is_sec then 'section_header' when is_sub then 'subsection_header' when {is_("text", P.TABLE_HEADER)} then 'table_header'
  when {is_("text", P.WARNING)} then 'warning_notice' when {is_("text", P.STEP)} or {is_("text", P.BULLET)} then 'procedure_step' else 'general_text' end as content_type,
  coalesce(sid, '') as section_id, coalesce(sname, '') as section_name, coalesce(sub, '') as subsection_type, coalesce(page, 0) as page_number from filled where pg is null),
state as (select *, last_value(case when content_type = 'table_header' then 1 when content_type in ('section_header', 'subsection_header') then 0 end ignore nulls) over ({where}) as open,
  last_value(case when content_type = 'table_header' then section_id end ignore nulls) over ({where}) as h_id,
  last_value(case when content_type = 'table_header' then section_name end ignore nulls) over ({where}) as h_name,
  last_value(case when content_type = 'table_header' then subsection_type end ignore nulls) over ({where}) as h_sub,
  last_value(case when content_type = 'table_header' then page_number end ignore nulls) over ({where}) as h_page,
  lead(text, 1) over (partition by doc_id order by idx) as n1, lead(text, 2) over (partition by doc_id order by idx) as n2, lead(text, 3) over (partition by doc_id order by idx) as n3 from typed),
body as (select *, ({is_("text", P.ROW)} and not {is_("text", P.NOT_ROW)}) as one,
  (not {is_("text", P.NOT_ROW)} and not {is_("text", P.VALUE)} and coalesce({is_("n1", P.VALUE)} and {is_("n2", P.VALUE)} and {is_("n3", P.VALUE)}, false)) as stack
  from state where open = 1 and content_type not in ('table_header', 'section_header', 'subsection_header')),
cells as (select *, case when one then trim({re("text", P.ROW, 1)}) else text end as comp,
  case when one then {re("text", P.ROW, 2)} else n1 end as c1, case when one then {re("text", P.ROW, 3)} else n2 end as c2, case when one then {re("text", P.ROW, 4)} else n3 end as c3
  from body where one or stack),
rows0 as (select *, {sql_number("c1")} as nm, {sql_number("c2")} as ft, {sql_number("c3")} as lb from cells),
rows1 as (select doc_id, {_text("nm", "ft", "lb")} as text, 'torque_table_row' as content_type, h_id as section_id, h_name as section_name, h_sub as subsection_type, h_page as page_number,
  idx as line_number, comp as component, nm as value_nm, ft as value_lbft, lb as value_lbin, cast(null as double) as value_mm, {_VARIANTS.format(c="h_name")} as vehicle_variant,
  0 as stage_number, true as is_safety_critical, false as has_condition, case when one then 0.98 else 0.96 end as confidence, 0 as place, one from rows0 where coalesce(nm, ft, lb) is not null),
stage as (select doc_id, text, 'multi_stage_torque' as content_type, section_id, section_name, subsection_type, page_number, idx as line_number, {_between("text")} as component,
  cast({re("text", P.STAGE, 2)} as double) as value_nm, case when {re("text", P.STAGE, 4)} = 'lb-ft' then cast({re("text", P.STAGE, 3)} as double) end as value_lbft,
  case when {re("text", P.STAGE, 4)} = 'lb-in' then cast({re("text", P.STAGE, 3)} as double) end as value_lbin, cast(null as double) as value_mm, {_LINE_VARIANTS.format(c="text")} as vehicle_variant,
  cast({re("text", P.STAGE, 1)} as int) as stage_number, true as is_safety_critical, false as has_condition, 0.96 as confidence, 0 as place from typed where {is_("text", P.STAGE)}),
tq as (select *, unnest(regexp_extract_all(text, {_q(P.TORQUE)}, 0)) as m, generate_subscripts(regexp_extract_all(text, {_q(P.TORQUE)}, 0), 1) - 1 as k from typed where not {is_("text", P.STAGE)} and {is_("text", P.TORQUE)}),
torque as (select doc_id, text, 'inline_torque' as content_type, section_id, section_name, subsection_type, page_number, idx as line_number,
  {_between(re("m", P.TORQUE, 1) + " || " + re("m", P.TORQUE, 5))} as component, cast({re("m", P.TORQUE, 2)} as double) as value_nm,
  case when {re("m", P.TORQUE, 4)} = 'lb-ft' then cast({re("m", P.TORQUE, 3)} as double) end as value_lbft, case when {re("m", P.TORQUE, 4)} = 'lb-in' then cast({re("m", P.TORQUE, 3)} as double) end as value_lbin,
  cast(null as double) as value_mm, {_LINE_VARIANTS.format(c="text")} as vehicle_variant, 0 as stage_number, true as is_safety_critical,
  (contains(lower(text), 'condition') or contains(lower(text), 'when')) as has_condition, 0.92 as confidence, k as place from tq),
dm as (select *, unnest(regexp_extract_all(text, {_q(P.DIMENSION)}, 1)) as m, generate_subscripts(regexp_extract_all(text, {_q(P.DIMENSION)}, 1), 1) - 1 as k from typed where not {is_("text", P.STAGE)} and {is_("text", P.DIMENSION)}),
dims as (select doc_id, text, 'dimensional_spec' as content_type, section_id, section_name, subsection_type, page_number, idx as line_number, {_between("text")} as component,
  cast(null as double) as value_nm, cast(null as double) as value_lbft, cast(null as double) as value_lbin, cast(m as double) as value_mm, {_LINE_VARIANTS.format(c="text")} as vehicle_variant,
  0 as stage_number, false as is_safety_critical, false as has_condition, 0.90 as confidence, k + 1000 as place from dm),
inl as (select * from stage union all select * from torque union all select * from dims),
runs as (select *, content_type in ('procedure_step', 'warning_notice') as anchor, sum(case when content_type not in ('procedure_step', 'warning_notice', 'general_text') then 1 else 0 end) over ({where}) as run from typed),
acts as (select * from (select *, bool_or(anchor) over (partition by doc_id, run order by idx rows between unbounded preceding and current row) as active from runs
  where content_type in ('procedure_step', 'warning_notice', 'general_text')) where active),
opens as (select *, case when {is_("text", P.STEP)} and anchor and lag(idx) over (partition by doc_id, run order by idx) is not null then 1 else 0 end as o,
  first_value(idx) over (partition by doc_id, run order by idx) as f_idx, first_value(page_number) over (partition by doc_id, run order by idx) as f_page, first_value(section_id) over (partition by doc_id, run order by idx) as f_id,
  first_value(section_name) over (partition by doc_id, run order by idx) as f_name, first_value(subsection_type) over (partition by doc_id, run order by idx) as f_sub from acts),
blocked as (select *, sum(o) over (partition by doc_id, run order by idx rows between unbounded preceding and current row) as block from opens),
blk0 as (select doc_id, run, block, string_agg(text, chr(10) order by idx) as text, min(f_id) as section_id, min(f_name) as section_name, min(f_sub) as subsection_type, min(f_page) as page_number, min(f_idx) as line_number, min(idx) as place from blocked group by doc_id, run, block),
blk as (select doc_id, text, 'procedure_step' as content_type, section_id, section_name, subsection_type, page_number, line_number, '' as component, cast(null as double) as value_nm, cast(null as double) as value_lbft,
  cast(null as double) as value_lbin, cast(null as double) as value_mm, cast([] as varchar[]) as vehicle_variant, 0 as stage_number, {is_("upper(text)", "WARNING|NOTICE|CAUTION")} as is_safety_critical, false as has_condition, 1.0 as confidence, place from blk0),
parts3 as (select * exclude (one), 0 as src, line_number as ord from rows1 union all select *, 1, line_number from inl union all select *, 3, place from blk),
segs as (select * exclude (src, ord, place), row_number() over (partition by doc_id order by src, ord, place, text) - 1 as seg_seq from parts3),
keyed as (select *, substr(trim(lower(component)), 1, 60) as kc from segs where content_type <> 'procedure_step'),
dedup as (select * exclude (kc, n, seg_seq, f), f as seg_seq from (select *, min(seg_seq) over (partition by doc_id, kc, value_nm, section_id) as f,
  row_number() over (partition by doc_id, kc, value_nm, section_id order by case when content_type = 'torque_table_row' then -seg_seq else seg_seq + 1099511627776 end) as n from keyed) where n = 1)
"""
