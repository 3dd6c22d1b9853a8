"""Documents in, answers out: ingest, retrieve, extract, validate; a batch of questions is one job."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.operators import answers, chunks, context, retrieval, segments
from specloom.plans import backends
from specloom.plans.history import History
from specloom.sources import readers, sinks
from specloom.sources.tables import forgotten, materialise

# fixed values: the questions of the four demos, with variant and whether specs alone are asked for where these are given
DEMO_QUERIES = [
    "Torque for brake caliper bolts",
    "Shock absorber lower nuts 4WD",
    "Wheel bearing and hub bolt torque",
    "Stage tightening sequence U-bolt",
    "Upper ball joint nut torque RWD",
    "Halfshaft assembled length",
    "Stabilizer bar link nuts SVT Raptor",
    "Tie-rod end nut torque",
    "Lower arm forward rearward nuts",
    "Wheel speed sensor bolt torque",
]
EXTRACTION_DEMO = [
    ("Torque for brake caliper bolts", None),
    ("Shock absorber lower nuts specification", "4WD"),
    ("Wheel bearing and hub bolt torque", None),
    ("Stage tightening sequence U-bolt rear", None),
    ("Upper ball joint nut torque", "RWD"),
    ("Halfshaft assembled length dimension", None),
    ("Stabilizer bar link nuts SVT Raptor torque", None),
    ("Tie-rod end nut torque specification", None),
]
RETRIEVAL_DEMO = [
    ("Torque for brake caliper bolts", None, True),
    ("Shock absorber lower nuts torque 4WD", "4WD", True),
    ("How to install lower control arm", None, False),
    ("Stage tightening sequence U-bolt nuts", None, True),
    ("Wheel bearing hub bolt torque specification", None, True),
]
SUGGESTIONS = [
    "torque for brake caliper bolts",
    "shock absorber lower nuts 4WD",
    "U-bolt tightening sequence stages",
    "halfshaft assembled length mm",
    "upper ball joint nut torque RWD",
    "stabilizer bar link nuts SVT Raptor",
]


def demo(name: str) -> list[tuple[str, str | None, bool]]:
    """(question, variant, specs alone) of a demo: api, extraction, retrieval or suggestions."""
    sets = {"api": DEMO_QUERIES, "extraction": EXTRACTION_DEMO, "retrieval": RETRIEVAL_DEMO, "suggestions": SUGGESTIONS}
    return [(*((x,) if isinstance(x, str) else x), None, True)[:3] if isinstance(x, str) else (*x, True)[:3] for x in sets[name]]


@dataclass(frozen=True)
class Config:
    """``k``: chunks for an answer, 1 to 20. ``layout_first``: PDFs go through the layout-keeping command before the other readers."""

    k: int = 5
    model: str = "llama3.1:8b"
    host: str = "http://localhost:11434"
    generic: bool = False
    with_kgcm: bool = False
    layout_first: bool = False

    def __post_init__(self):
        if not 1 <= self.k <= 20:
            raise ValueError("k must be 1 to 20")

    def patched(self, **changes) -> Config:
        return replace(self, **changes)


def index(documents: DataFrame, embedder: backends.Embedder, dialect: P.Dialect = P.WORKSHOP) -> DataFrame:
    """Chunks of documents with vectors; a document without procedures or specs has fewer chunks, not an error.

    The generic dialect adds the rows of tables found by position, a column ``tables``.
    """
    tables = segments.document_tables(documents) if dialect is P.GENERIC and "tables" in documents.columns else None
    every, kept = segments.extract(documents.select("doc_id", "text"), dialect, tables)
    table = chunks.build(every, kept, context.hints(every, kept))
    return table.withColumn("embedding", embedder.documents(F.col("embed_text")))


@dataclass
class Engine:
    """Sessions of documents under one folder, and questions to them."""

    spark: SparkSession
    path: str
    embedder: backends.Embedder = field(default_factory=backends.HashEmbedder)
    extractor: backends.Extractor | None = None
    config: Config = field(default_factory=Config)

    def __post_init__(self):
        self.bundle = sinks.IndexBundle(self.spark, f"{self.path}/index")
        self.history = History(self.spark, f"{self.path}/history")

    def ingest(self, path: str, session_id: str | None = None) -> str:
        """Index the text and PDF files at ``path``; returns the session's id. Other and empty files are refused."""
        readers.check_upload(self.spark, path)
        session_id = session_id or uuid.uuid4().hex
        docs = readers.read_documents(self.spark, path, generic=self.config.generic, layout_first=self.config.layout_first)
        self.add(docs.select("doc_id", "text", "tables"), session_id)
        return session_id

    def health(self) -> dict:
        """Whether sessions can be read, how many there are, and whether a model answers."""
        return {"status": "ok", "sessions": len(self.bundle.sessions()), "model": bool(self.extractor and self.extractor.online())}

    def configure(self, **changes) -> Config:
        """Change the configuration; what was read under the old one is dropped and read again."""
        self.config = self.config.patched(**changes)
        self.bundle = sinks.IndexBundle(self.spark, f"{self.path}/index")
        self.spark.catalog.clearCache()
        return self.config

    def add(self, documents: DataFrame, session_id: str) -> None:
        """Index (doc_id, text) and, in the generic dialect, tables. The session's chunks are numbered across its documents."""
        dialect = P.GENERIC if self.config.generic else P.WORKSHOP
        with forgotten():
            made = numbered(materialise(index(documents, self.embedder, dialect), "session-chunks"))
            made = made.withColumn("chunk_id", F.concat_ws("/", F.col("doc_id").cast("string"), "chunk_id"))
            keyed = made.select(F.col("chunk_type").alias("index_key"), "chunk_pos", F.col("embed_text").alias("text"))
            self.bundle.save(session_id, made, retrieval.bm25_index(keyed))

    def retrieve(self, queries: DataFrame, session_id: str) -> DataFrame:
        """Chunks for (query_id, query, variant, spec_only, k): both indexes, fused, filtered, the first k."""
        table, bm25 = self.bundle.load(session_id)
        k = self.config.k
        asked = queries.withColumn("qvec", self.embedder.queries(F.col("query")))
        fused = retrieval.search(table, bm25, asked, k)
        rows = fused.join(table.drop("session_id", "embedding"), ["chunk_type", "chunk_pos"]).join(F.broadcast(queries.select("query_id", "query", "variant", "force_llm")), "query_id")
        return retrieval.first_k(retrieval.relevant(retrieval.keep_variant(rows, F.col("variant"))), k)

    def answer(self, queries: DataFrame, session_id: str) -> DataFrame:
        """query_id, position and the full records for a batch of questions."""
        found = self.retrieve(with_defaults(queries), session_id)
        fast = ~F.coalesce("force_llm", F.lit(False)) & answers.eligible(self.config.with_kgcm)
        records = answers.unpivot(found.filter(fast), self.config.with_kgcm)
        rest = found.filter(~F.coalesce(fast, F.lit(False)))
        if self.extractor is not None and self.extractor.online():
            first = rest.groupBy("query_id").agg(F.min_by(F.struct("section_id", "section_name", "vehicle_variant", F.col("display_text").alias("raw_text")), "place").alias("f")).select("query_id", "f.*")
            told = backends.respond(backends.prompts(rest), self.extractor).join(first, "query_id")
            more = answers.parse_responses(told)
        else:
            more = answers.fallback(rest)
        return answers.validate(records.unionByName(more))

    def responses(self, queries: DataFrame, session_id: str) -> DataFrame:
        """One row for each question, also those without any record: results, full_results, metadata."""
        rows = with_defaults(queries).select("query_id", "query", "variant")
        out = answers.with_empty(rows, self.answer(queries, session_id))
        short = F.transform("full_results", lambda r: F.struct(*(r[n].alias(n) for n in sinks.COMPACT)))
        return out.select("query_id", "query", "variant", short.alias("results"), "full_results", F.struct(F.size("full_results").alias("total_specs_found"), "fast_path_count", "llm_path_count", F.lit(self.extractor is not None).alias("model")).alias("metadata"))

    def ask(self, questions: list[str], session_id: str, variant: str | None = None, spec_only: bool = True, force_llm: bool = False, remember: bool = False) -> list[dict]:
        rows = [(i, q, variant, spec_only, force_llm) for i, q in enumerate(questions)]
        queries = self.spark.createDataFrame(rows, "query_id int, query string, variant string, spec_only boolean, force_llm boolean")
        got = self.responses(queries, session_id).persist()
        try:
            if remember:
                self.history.append(got.select(F.expr("uuid()").alias("entry_id"), F.current_timestamp().alias("ts"), "query", "variant", F.size("results").cast("long").alias("n_results")))
            return [r.asDict(recursive=True) for r in got.orderBy("query_id").collect()]
        finally:
            got.unpersist()


def numbered(chunks_: DataFrame) -> DataFrame:
    """Chunks numbered through all documents of a session for each kind, in the order (doc_id, place): documents'
    numbers of chunks are summed up, first in ranges of documents, so no task reads all of a large session."""
    counts = chunks_.groupBy("chunk_type", "doc_id").agg(F.count("*").alias("n"))
    ranged = materialise(counts.repartitionByRange("chunk_type", "doc_id").withColumn("_range", F.spark_partition_id()), "session-counts")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("chunk_type", "_range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("chunk_type", "_range", F.coalesce(F.sum("n").over(before("chunk_type").orderBy("_range")), F.lit(0)).alias("_above"))
    inside = F.coalesce(F.sum("n").over(before("chunk_type", "_range").orderBy("doc_id")), F.lit(0))
    first = ranged.withColumn("_first", inside).join(ranges, ["chunk_type", "_range"]).select("chunk_type", "doc_id", (F.col("_first") + F.col("_above")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("chunk_type", "doc_id").orderBy("chunk_pos")) - 1
    return chunks_.withColumn("_own", own).join(first, ["chunk_type", "doc_id"]).withColumn("chunk_pos", (F.col("_first") + F.col("_own")).cast("int")).drop("_first", "_own")


def summary(responses: DataFrame) -> DataFrame:
    """Totals of a batch of ``Engine.responses``."""
    return answers.summary(responses.select("full_results", "metadata.fast_path_count", "metadata.llm_path_count"))


def with_defaults(queries: DataFrame) -> DataFrame:
    for name, value in (("variant", F.lit(None).cast("string")), ("spec_only", F.lit(True)), ("force_llm", F.lit(False))):
        if name not in queries.columns:
            queries = queries.withColumn(name, value)
    return queries
