"""Registered queries of readers, sinks, chunking, model responses and batch summaries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions import text as X
from specloom.operators import answers, chunks, context, retrieval, segments, specs, structure
from specloom.plans import backends, manual
from specloom.plans.queries import _BM25, _DENSE, _ENRICH_SQL, _FAST0, _PACK, _PH, _SENTENCES, _V, _fast, _generic_flat, _queries, _segments, flat, query, read
from specloom.sources import readers, sinks
from specloom.sources.tables import new_path

RECURSIVE = manual.ctes().replace("with numbered", "with recursive numbered", 1)


def strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


def split_sql(source: str, keys: str) -> str:
    """Expressions ``pieces`` (keys, k, piece): the texts of ``source`` (keys, text) through the procedure splitter."""
    fits = "case when instr(substr(rest, 1, 400), ' ') > 0 then length(substr(rest, 1, 400)) - instr(reverse(substr(rest, 1, 400)), ' ') else 400 end"
    return f"""sp0 as (select {keys}, text, list_filter(list_transform(string_split(regexp_replace(text, '(\\b\\d{{1,2}}\\.\\s+\\S)', chr(1) || '\\1', 'g'), chr(1)), lambda x: {strip_sql("x")}), lambda x: x <> '') as steps, {_PACK % _SENTENCES} as s from {source} where length(text) > 400),
sp1 as (select {keys}, case when len(steps) <= 1 or list_max(list_transform(steps, lambda x: length(x))) > 800 then case when s.buf <> '' then list_append(s.done, s.buf) else s.done end else steps end as ps from sp0),
sp2 as (select {keys}, i, {strip_sql("case when i > 1 then right(ps[i - 1], 60) || ' ' || ps[i] else ps[i] end")} as c from (select *, unnest(range(1, len(ps) + 1)) as i from sp1)),
cuts as (select {keys}, i, 0 as j, '' as piece, c as rest, true as going from sp2
 union all select {keys}, i, j + 1, case when length(rest) > 400 then substr(rest, 1, {fits}) else rest end, case when length(rest) > 400 then {strip_sql(f"substr(rest, {fits} + 1)")} else '' end, length(rest) > 400 from cuts where going),
sp3 as (select {keys}, i, j, {strip_sql("piece")} as piece from cuts where j > 0),
pieces as (select {keys}, cast(row_number() over (partition by {keys} order by i, j) - 1 as int) as k, piece from sp3 where piece <> '' or j = 1 union all select {keys}, 0, text from {source} where length(text) <= 400)"""


# ---- chunks ----


@query(f"with recursive {split_sql('documents', 'doc_id')} select * from pieces")
def procedure_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through the procedure splitter: steps or sentences, overlap, hard cuts."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.procedure_chunks(F.col("text"))).alias("k", "piece"))


_HINTS = f"""bare as (select doc_id, line_number, seg_seq, section_id, value_nm from dedup where trim(component) = '' and line_number <> 0),
byv as (select doc_id, line_number, seg_seq, hint from (select b.doc_id, b.line_number, b.seg_seq, r.component as hint,
 row_number() over (partition by b.doc_id, b.line_number, b.seg_seq order by abs(b.value_nm - r.value_nm) / greatest(r.value_nm, 1), abs(r.line_number - b.line_number), r.seg_seq) as n
 from bare b join dedup r on b.doc_id = r.doc_id and b.section_id = r.section_id and trim(r.component) <> '' and r.content_type = 'torque_table_row' and r.value_nm <> 0
 and abs(b.value_nm - r.value_nm) / greatest(r.value_nm, 1) <= 0.05 where b.value_nm is not null) where n = 1),
trims as (select * from (select doc_id, line_number, seg_seq, nullif({_V}, '') as v, nullif(trim({_PH}), '') as p from segs) where v is not null),
around as (select b.doc_id, b.line_number, b.seg_seq, byv.hint as by_value, n.near, coalesce(x.line, y.line) as scan_line, coalesce(x.v, y.v) as variant, case when x.line is not null then x.p end as phrase from bare b
 left join byv on b.doc_id = byv.doc_id and b.line_number = byv.line_number and b.seg_seq = byv.seg_seq
 left join lateral (select trim(component) as near from segs s where s.doc_id = b.doc_id and s.line_number between b.line_number - 30 and b.line_number - 1 and trim(s.component) <> '' order by s.line_number desc, s.seg_seq limit 1) n on true
 left join lateral (select line_number as line, v, p from trims t where t.doc_id = b.doc_id and t.line_number between b.line_number - 150 and b.line_number - 1 order by t.line_number desc, p is not null desc, t.seg_seq limit 1) x on true
 left join lateral (select line_number as line, v from trims t where t.doc_id = b.doc_id and t.line_number between b.line_number + 1 and b.line_number + 40 order by t.line_number, t.seg_seq limit 1) y on true),
worded as (select *, coalesce(by_value, near, case when phrase is not null then phrase || ' (' || variant || ')' else variant end) as hint0, case when by_value is null and near is null then scan_line end as source from around),
lasts as (select * from (select *, row_number() over (partition by doc_id, line_number order by seg_seq desc) as n from worded where hint0 is not null) where n = 1),
hints as (select doc_id, line_number, case when source is not null and line_number < max(line_number) over (partition by doc_id, source) then variant else hint0 end as hint from lasts)"""


@query(f"{manual.ctes()}, {_HINTS} select doc_id, line_number, hint from hints")
def context_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three lookups with the deferred-step rule."""
    every, kept = segments.extract(manual.documents(spark, sf_dir))
    return context.hints(every, kept)


_CHUNK = "section_id, section_name, subsection_type, page_number, component, array_to_string(vehicle_variant, ',') as variants, content_type, is_safety_critical, cast(confidence as double) as confidence, stage_number"


@query(
    f"""{RECURSIVE}, {_HINTS}, named as (select d.*, case when trim(d.component) = '' then coalesce(h.hint, '') else trim(d.component) end as comp from dedup d left join hints h on d.doc_id = h.doc_id and d.line_number = h.line_number),
specs1 as (select *, cast(row_number() over (partition by doc_id order by seg_seq) - 1 as int) as chunk_pos from named),
procs as (select doc_id, seg_seq, text from segs where content_type = 'procedure_step'), {split_sql('procs', 'doc_id, seg_seq')},
long as (select doc_id, seg_seq, k, {strip_sql('piece')} as piece from pieces where length({strip_sql('piece')}) >= 20),
procs1 as (select l.piece as text, s.* exclude (text), '' as comp, cast(row_number() over (partition by l.doc_id order by l.seg_seq, l.k) - 1 as int) as chunk_pos from long l join segs s on l.doc_id = s.doc_id and l.seg_seq = s.seg_seq)
select doc_id, format('spec_{{:04d}}', chunk_pos) as chunk_id, 'spec' as chunk_type, {_ENRICH_SQL} as embed_text, text as display_text, {_CHUNK}, chunk_pos from specs1
union all select doc_id, format('proc_{{:05d}}', chunk_pos), 'procedure', {_ENRICH_SQL}, text, {_CHUNK}, chunk_pos from procs1"""
)
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec and procedure chunks of the manual, with hints, enrichment, splitting and ids."""
    every, kept = segments.extract(manual.documents(spark, sf_dir))
    built = chunks.build(every, kept, context.hints(every, kept))
    return built.withColumn("variants", F.array_join("vehicle_variant", ",")).drop("spec_value", "vehicle_variant")


# ---- documents with little in them; other shapes of the generic dialect ----

_KIND = "case n_nationkey % 3 when 0 then {0} when 1 then {1} else {2} end"
_SPARSE = _KIND.format(
    "'SECTION 1: ' || n_name || chr(10) || 'Tighten the cap to ' || (n_nationkey + 5) || ' Nm (' || (n_nationkey + 3) || ' lb-ft).' || chr(10) || '1. Remove the ' || n_name || ' cap.'",
    "'SECTION 2: ' || n_name || chr(10) || '1. Remove the ' || n_name || ' cap.' || chr(10) || '2. Put it aside.'",
    "'About ' || n_name || chr(10) || 'one paragraph.' || chr(10) || chr(10) || 'And one more about ' || n_name",
)


@query(
    """select n_nationkey as doc_id, kind, n as segments from nation, (values (0, 'inline_torque', 1, 0), (1, 'procedure_step', 2, 1), (2, 'procedure_step', 2, 2)) as t(r, kind, n, x) where n_nationkey % 3 = r and r < 1
union all select n_nationkey, 'procedure_step', 2 from nation where n_nationkey % 3 = 1
union all select n_nationkey, 'procedure_step', 2 from nation where n_nationkey % 3 = 2"""
)
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec segments; of documents without any, all segments; of documents without segments, their paragraphs."""
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    docs = spark.sql(f"select n_nationkey as doc_id, {_SPARSE} as text from nation".replace("chr(10)", "'\\n'"))
    _, kept = segments.extract(docs)
    return kept.groupBy("doc_id", F.col("content_type").alias("kind")).agg(F.count("*").cast("int").alias("segments"))


#: Lines of the generic dialect and the type that each has.
_SHAPES = [("SECTION 7-1: Name {n}", "section_header"), ("AB-12  NAME {n}", "section_header"), ("SPECIFICATION", "subsection_header"), ("Diagnosis and Testing", "subsection_header"), ("DESCRIPTION AND OPERATION", "subsection_header"), ("Removal And Installation", "subsection_header"), ("DISASSEMBLY AND ASSEMBLY", "subsection_header"), ("General Procedure", "subsection_header"), ("SERVICE SPECIFICATIONS", "subsection_header"), ("INSPECTION AND VERIFICATION", "subsection_header"), ("Adjustments", "subsection_header"), ("TORQUE SPECIFICATION", "subsection_header"), ("FASTENER SPECIFICATIONS", "subsection_header"), ("Tightening Torques", "subsection_header"), ("CAUTION: hot {n}", "warning_notice"), ("note that {n}", "warning_notice"), ("12. Lift {n}", "procedure_step"), ("z drop {n}", "procedure_step"), ("• turn {n}", "procedure_step"), ("- push {n}", "procedure_step"), ("* pull {n}", "procedure_step"), ("ALL CAPITALS, (HERE)", "subsection_header"), ("Plain words {n}", "general_text"), ("Nm lb-ft", "general_text")]
_SHAPE_ROWS = ", ".join(f"({i}, '{t}', '{k}')" for i, (t, k) in enumerate(_SHAPES))
# the last two shapes of headers are not kept as the current subsection
_SHAPE_CTES = f"""shapes as (select n_nationkey as doc_id, i as idx, replace(t, '{{n}}', n_name) as text, k as content_type from nation, (values {_SHAPE_ROWS}) as s(i, t, k)),
 kept as (select *, case when i2 is not null then upper(text) when content_type = 'section_header' then '' end as sub from (select *, case when content_type = 'subsection_header' and idx < 21 then idx end as i2 from shapes))"""


@query(
    f"""with {_SHAPE_CTES} select doc_id, idx, text, content_type, case when idx = 0 then '7-1' else 'AB-12' end as section_id, case when idx = 0 then 'Name ' || substr(text, 19) else 'NAME ' || n_name end as section_name,
 coalesce(last_value(sub ignore nulls) over (partition by doc_id order by idx rows between unbounded preceding and current row), '') as subsection_type from kept join nation on doc_id = n_nationkey"""
)
def generic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of line of the generic dialect, with the section and subsection it stands under."""
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    rows = spark.sql(f"select n_nationkey as doc_id, i, replace(t, '{{n}}', n_name) as line from nation cross join (select * from values {_SHAPE_ROWS} as s(i, t, k))")
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return structure.parse(docs, P.GENERIC).drop("page_number")


_STACKED = "'AB-' || cast(n_nationkey as string) || '  TITLE ' || n_name || {nl} || 'Part N·m ft·lbf kgf·cm' || {nl} || n_name || ' stud' || {nl} || cast(n_nationkey + 10 as string) || {nl} || case when n_nationkey % 4 = 0 then '-' else cast(n_nationkey + 7 as string) end || case when n_nationkey % 2 = 0 then {nl} || cast(n_nationkey + 100 as string) else '' end || {nl} || 'End of the table here'"


@query(
    """select n_nationkey as doc_id, n_name || ' stud' as component, cast(n_nationkey + 10 as double) as value_nm, case when n_nationkey % 4 <> 0 then cast(n_nationkey + 7 as double) end as value_lbft,
 case when n_nationkey % 2 = 0 then cast(n_nationkey + 100 as double) end as value_kgcm, cast(0.95 as double) as confidence from nation"""
)
def generic_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of generic tables whose two or three values stand on lines of their own."""
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    docs = spark.sql(f"select n_nationkey as doc_id, {_STACKED.format(nl=chr(39) + chr(92) + 'n' + chr(39))} as text from nation")
    return _generic_flat(specs.generic_table_rows(structure.parse(docs, P.GENERIC))).select("doc_id", "component", "value_nm", "value_lbft", "value_kgcm", "confidence")


@query(
    """with g as (select p_partkey as doc_id, p_size, 'AB-1  TITLE' as t from part) select doc_id, 'torque_table_row' as content_type, 'Pin' || doc_id || 'x nut' as component, cast(p_size as double) as value_nm, 0 as seg_seq from g
union all select doc_id, 'torque_table_row', 'Cell ' || doc_id, cast(p_size + 1 as double), 1 from g"""
)
def coordinate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of generic documents that come with tables found by position: the tables' rows stand after the text's."""
    part = read(spark, sf_dir, "part")
    size = lambda k: (F.col("p_size") + k).cast("string")
    text = F.concat(F.lit("AB-1  TITLE\nPart N·m ft·lbf\nPin"), F.col("p_partkey").cast("string"), F.lit("x nut "), size(0), F.lit(" -\n"))
    rows = F.array(F.array(F.lit("Part"), F.lit("Torque N·m")), F.array(F.concat(F.lit("Cell "), F.col("p_partkey").cast("string")), size(1)))
    tables = F.array(F.struct(F.lit(1).alias("page"), rows.alias("rows")))
    docs = part.select(F.col("p_partkey").alias("doc_id"), text.alias("text"), tables.alias("tables"))
    every, _ = segments.extract(docs.select("doc_id", "text"), P.GENERIC, segments.document_tables(docs))
    return every.filter("content_type = 'torque_table_row'").select("doc_id", "content_type", "component", F.col("spec_value.value_nm").alias("value_nm"), F.col("seg_seq").cast("int").alias("seg_seq"))


# ---- readers ----


def _files(df: DataFrame, key: str, text: str, name: str) -> str:
    """A text file for each row, in a folder of its own."""
    path = new_path(df.sparkSession, name)
    df.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("value")).write.partitionBy("_k").option("lineSep", "\n").text(path)
    return path


@query("select n_nationkey, n_name || chr(10) || n_comment_ || chr(10) as text, 'text' as method, cast(length(n_name) + length(n_comment_) + 2 as bigint) as total_chars, cast(2 as bigint) as total_lines from (select *, 'é line of ' || n_name as n_comment_ from nation)")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files told from PDFs by their first bytes, with the numbers of characters and line breaks."""
    nation = read(spark, sf_dir, "nation").withColumn("t", F.concat("n_name", F.lit("\né line of "), "n_name"))
    path = _files(nation, "n_nationkey", "t", "text-files")
    sizes = readers.read_texts(spark, f"{path}/*/*.txt").select("doc_id", "total_chars", "total_lines")
    docs = readers.read_documents(spark, f"{path}/*/*.txt").join(sizes, "doc_id")
    return docs.select(F.regexp_extract("doc_id", r"_k=(\d+)/", 1).cast("int").alias("n_nationkey"), "text", F.col("extraction_method").alias("method"), "total_chars", "total_lines")


@query("select n_name as query, count(*) as n from nation where n_nationkey % 3 = 0 group by all union all select 'torque of ' || n_name, count(*) from nation where n_nationkey % 3 = 1 group by all union all select '# kept ' || n_name, count(*) from nation where n_nationkey % 6 = 5 group by all")
def question_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of questions: blank lines go, and lines that begin with '#' before they are trimmed."""
    k = F.col("n_nationkey")
    line = F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.concat(F.lit("  torque of "), "n_name", F.lit("  "))).when(k % 6 == 5, F.concat(F.lit(" # kept "), "n_name")).otherwise(F.concat(F.lit("# gone "), "n_name"))
    rows = read(spark, sf_dir, "nation").select(F.concat(line, F.lit("\n   ")).alias("value"))
    path = new_path(spark, "questions")
    rows.coalesce(1).write.text(path)
    return readers.read_queries(spark, path).groupBy("query").agg(F.count("*").alias("n"))


@query(f"{manual.ctes()} select doc_id, seg_seq, text, content_type, section_id, component, value_nm, value_lbft, value_lbin, value_mm, stage_number, is_safety_critical, has_condition, cast(confidence as double) as confidence from segs")
def segment_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments written as JSON, a folder for each document, and read again."""
    path = new_path(spark, "segment-json")
    sinks.write_segments(_segments(spark, sf_dir).withColumn("seq", F.col("seg_seq")), path)
    number = F.regexp_extract("doc_id", r"doc_id=(\d+)/", 1).cast("int")
    back = readers.read_segments(spark, f"{path}/*/*.json", multi_line=False, more="seq long")
    return flat(back.withColumn("doc_id", number), "seq").select("doc_id", F.col("seq").alias("seg_seq"), "text", "content_type", "section_id", "component", "value_nm", "value_lbft", "value_lbin", "value_mm", "stage_number", "is_safety_critical", "has_condition", "confidence")


@query(f"{manual.ctes()} select doc_id, content_type, cast(count(*) as bigint) as n from segs group by all")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' counters written as JSON and read again."""
    docs = manual.documents(spark, sf_dir)
    every, kept = segments.extract(docs)
    path = new_path(spark, "metadata-json")
    sinks.write_metadata(segments.metadata(docs, every, kept), path)
    back = spark.read.schema("doc_id int, segments_by_type map<string,long>").json(path)
    return back.select("doc_id", F.explode("segments_by_type").alias("content_type", "n"))


@query("select doc_id, page, count(*) as n from (select o_custkey % 50 as doc_id, o_orderkey % 3 + 1 as page, count(*) as k from orders group by all) where k > 3 group by all")
def table_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with more than three lines of two numbers side by side."""
    lines = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc_id"), (F.col("o_orderkey") % 3 + 1).alias("page"), F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.lit("12")).alias("line"))
    pages = lines.groupBy("doc_id", "page").agg(F.concat(F.lit("one 1 x 2\n"), F.array_join(F.collect_list("line"), "\n")).alias("text"))
    of = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page", "text")).alias("pages"))
    return of.select("doc_id", F.explode(readers.table_pages(F.col("pages"))).alias("page")).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("select n_nationkey, substr(repeat('é' || n_name || ' x', 60), 1, 600) as message from nation where n_nationkey % 2 = 0 union all select n_nationkey, 'bad' || chr(10) || n_name || chr(9) || '!' from nation where n_nationkey % 2 = 1")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without controls, cut at 600 characters."""
    long = F.concat(F.lit("\x01"), F.repeat(F.concat(F.lit("é\x7f"), "n_name", F.lit(" x")), 60))
    raw = F.when(F.col("n_nationkey") % 2 == 0, long).otherwise(F.concat(F.lit(" \tbad\n\x00"), "n_name", F.lit("\t\r!\n")))
    return read(spark, sf_dir, "nation").select("n_nationkey", X.error_text(raw).alias("message"))


# ---- sinks of records ----

_RECORDS = "select *, case when rec.u = 'mm' or content_type = 'dimensional_spec' then 'Dimension' else 'Torque' end as spec_type from recs"


@query(f"{manual.ctes()}, {_FAST0} select '\"' || component || '\",\"' || spec_type || '\",\"' || rec.v || '\",\"' || rec.u || '\",\"' || section_id || '\",\"' || 'RWD;4WD' || '\",\"table\",\"' || cast(cast(confidence as double) as varchar) || '\"' as line from ({_RECORDS})")
def csv_always_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight-column CSV lines, every cell quoted, variants joined by ';'."""
    return sinks.csv_lines_always_quoted(_fast(spark, sf_dir).withColumn("vehicle_variant", F.array(F.lit("RWD"), F.lit("4WD"))))


@query(f"{manual.ctes()}, {_FAST0} select component || ',' || spec_type || ',' || rec.v || ',' || rec.u || ',' || section_id || ',' || 'RWD|4WD' as line from ({_RECORDS})")
def csv_never_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six-column CSV lines, nothing quoted, variants joined by '|'."""
    return sinks.csv_lines_never_quoted(_fast(spark, sf_dir).withColumn("vehicle_variant", F.array(F.lit("RWD"), F.lit("4WD"))))


@query(f"{manual.ctes()}, {_FAST0} select doc_id as query_id, cast(row_number() over (partition by doc_id order by seg_seq, k) - 1 as int) as position, component, spec_type, rec.v as value, rec.u as unit from ({_RECORDS})")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's records as one JSON array, flattened again to a row for each record."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("seq")) - 1
    exported = sinks.json_records(_fast(spark, sf_dir).withColumn("position", place))
    read_back = F.from_json("json", "array<struct<component:string,spec_type:string,value:string,unit:string>>")
    return exported.select("query_id", F.posexplode(read_back).alias("position", "r")).select("query_id", "position", "r.*")


# ---- model responses, empty answers, summaries ----

_SAID = """case p_partkey % 6 when 0 then '{"specs": [{"component": "' || p_name || '", "spec_type": "Torque", "value": "' || p_size || '", "unit": "Nm"}], "confidence": 0.9}'
 when 1 then 'Sure. Here it is: {"specs": [{"component": " ' || p_name || ' ", "value": "' || p_size || '", "unit": "mm"}, {"component": "", "value": "1", "unit": "Nm"}]} Done.'
 when 2 then '{"specs": [{"component": "' || p_name || '", "value": "7", "unit": "Nm"}], "confidence": 0.29}' when 3 then '{"specs": [{"component": "' || p_name || '", "value": "8", "unit": "Nm"}], "confidence": 0.30}'
 when 4 then 'no idea' else '{"specs": []}' end"""


@query(
    """select p_partkey as query_id, p_name as component, 'Torque' as spec_type, case p_partkey % 6 when 3 then '8' else cast(p_size as varchar) end as value, case p_partkey % 6 when 1 then 'mm' else 'Nm' end as unit,
 cast(case p_partkey % 6 when 0 then 0.9 when 1 then 0.8 else 0.30 end as double) as confidence from part where p_partkey % 6 in (0, 1, 3)"""
)
def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of responses that are JSON, or hold it, or don't; unsure ones and incomplete records go."""
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    told = spark.sql(f"select p_partkey as query_id, {_SAID} as response, '1' as section_id, 'N' as section_name, array('RWD') as vehicle_variant, 'raw' as raw_text from part".replace("' || p_size || '", "' || cast(p_size as string) || '"))
    return answers.parse_responses(told).select("query_id", "component", "spec_type", "value", "unit", "confidence")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each nation; every third has records, of which every second was read from a table."""
    n = read(spark, sf_dir, "nation")
    queries = n.select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    records = n.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("n_regionkey") + 1)).alias("_i")).select("query_id", F.col("_i").cast("string").alias("value"), F.when(F.col("_i") % 2 == 0, "table").otherwise("regex_fallback").alias("source"))
    return answers.with_empty(queries, records)


@query("select n_nationkey as query_id, n_name as query, case when n_nationkey % 3 = 0 then n_regionkey + 1 else 0 end as total_specs_found, case when n_nationkey % 3 = 0 then cast((n_regionkey + 1) // 2 as bigint) else 0 end as fast_path_count, case when n_nationkey % 3 = 0 then cast(n_regionkey + 1 - (n_regionkey + 1) // 2 as bigint) else 0 end as llm_path_count from nation")
def empty_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each question, also for those without a record."""
    return _asked(spark, sf_dir).select("query_id", "query", F.size("full_results").alias("total_specs_found"), "fast_path_count", "llm_path_count")


@query("select count(*) as queries, cast(sum(n) as bigint) as specs, cast(sum(n // 2) as bigint) as fast, cast(sum(n - n // 2) as bigint) as other, avg(n) as specs_per_query from (select case when n_nationkey % 3 = 0 then n_regionkey + 1 else 0 end as n from nation)")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a batch of responses."""
    return answers.summary(_asked(spark, sf_dir))


@query(
    """select p_partkey, case when p_partkey % 2 = 0 then cast(p_size as varchar) else p_size || '.5' end as shown, case when p_partkey % 8 = 0 then 'nm' when p_partkey % 4 = 0 then 'lb-ft' when p_partkey % 4 = 1 then 'length' when p_partkey % 4 = 2 then 'angle' else 'other' end as unit_group,
 case when p_size > 40 then 'high' when p_size > 20 then 'medium' else 'low' end as band from part"""
)
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a record is shown: '.0' goes, units fall into groups, confidences into bands."""
    k, size = F.col("p_partkey"), F.col("p_size")
    value = F.when(k % 2 == 0, F.concat(size.cast("string"), F.lit(".0"))).otherwise(F.concat(size.cast("string"), F.lit(".5")))
    unit = F.when(k % 8 == 0, "Nm").when(k % 4 == 0, "lb-ft").when(k % 4 == 1, "mm").when(k % 4 == 2, "degrees").otherwise("pieces")
    sure = F.when(size > 40, 0.96).when(size > 20, 0.95).otherwise(0.8)
    return read(spark, sf_dir, "part").select("p_partkey", answers.shown_value(value).alias("shown"), answers.unit_group(unit).alias("unit_group"), answers.confidence_band(sure).alias("band"))


# ---- search over two kinds of chunks ----


@query(
    f"""with {_BM25}, {_DENSE}, kinds as (select * from (values ('en', 'spec', 20, 0), ('fr', 'procedure', 10, 1)) as t(index_key, chunk_type, wide, t)),
found as (select query_id, chunk_type, t, wide, chunk_pos, min(dr) as dr, min(sr) as sr from (select query_id, index_key, chunk_pos, rank as dr, null as sr from dense union all select query_id, index_key, chunk_pos, null, rank from bm25) join kinds using (index_key)
 where coalesce(dr, sr) < wide and (t = 0 or query_id % 2 = 0) group by all),
fused as (select * from (select *, row_number() over (partition by query_id, t order by round(coalesce(1.0 / (61 + dr), 0.0) + coalesce(1.0 / (61 + sr), 0.0), 6) desc, coalesce(dr, 1073741824), coalesce(sr, 1073741824)) - 1 as rank from found) where rank < wide)
select query_id, chunk_type, chunk_pos, place from (select *, cast(row_number() over (partition by query_id order by rank, t) - 1 as int) as place from fused) where place < 5"""
)
def two_kinds_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chunks for each question: 4 k fetched from one index, 2 k from the other; every second question skips the other."""
    vectors = read(spark, sf_dir, "embeddings")
    kind = F.when(F.col("lang") == "en", "spec").when(F.col("lang") == "fr", "procedure")
    docs = read(spark, sf_dir, "documents").select(kind.alias("chunk_type"), F.col("doc_id").alias("chunk_pos"), "text", (F.col("doc_id") % vectors.count()).alias("vec_id")).filter("chunk_type is not null")
    index = retrieval.bm25_index(docs.select(F.col("chunk_type").alias("index_key"), "chunk_pos", "text"))
    table = docs.join(vectors.select("vec_id", "embedding"), "vec_id").select("chunk_type", "chunk_pos", "embedding")
    asked = _queries(spark).withColumn("spec_only", F.col("query_id") % 2 == 1).withColumn("vec_id", F.col("query_id") * 7 + 3).join(vectors.select("vec_id", F.col("embedding").alias("qvec")), "vec_id")
    return retrieval.search(table, index, asked, 5).filter("place < 5").select("query_id", "chunk_type", "chunk_pos", "place")


@query(
    """with toks as (select p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_name), '[a-z0-9]+')) as t from part),
hashed as (select p_partkey, cast(cast('0x' || substr(md5(t), 1, 8) as bigint) % 64 as int) as place, case when substr(md5(t), 9, 1) < '8' then 1.0 else -1.0 end as s from toks),
summed as (select p_partkey, place, sum(cast(s as double)) as v from hashed group by all)
select p_partkey, place, round(v / sqrt(sum(v * v) over (partition by p_partkey)), 5) as value from summed where v <> 0 qualify true"""
)
def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default embedding: places of unit vectors that are not zero."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_name")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.posexplode(backends.HashEmbedder().documents(text)).alias("place", "v"))
    return rows.filter("v != 0").select("p_partkey", "place", F.round(F.col("v").cast("double"), 5).alias("value"))


@query("select n_nationkey, 'Name: ' || n_name || chr(10) || '  é - end' || chr(10) as text from nation")
def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts written as files, a folder for each document, and read again."""
    raw = F.concat(F.lit("\x01Name: "), "n_name", F.lit("\n  é - end \n\n"))
    docs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), X.clean(raw).alias("text"))
    path = new_path(spark, "cleaned")
    sinks.write_text(docs, path)
    return readers.read_texts(spark, f"{path}/*/*.txt").select(F.regexp_extract("doc_id", r"doc_id=(\d+)/", 1).cast("int").alias("n_nationkey"), "text")
