"""Inverted index, exact vector search and rank fusion, for batches of queries.

Indexes are tables keyed by ``index_key`` (a session, a chunk type …) and chunk; the
statistics are per key. Queries are a table (query_id, query); one job answers them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.text import tokens
from specloom.sources.tables import materialise

K1, B, EPSILON, DAMPING = 1.5, 0.75, 0.25, 60


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame  # index_key, chunk_pos, dl, term, tf; a term's tf may be dealt over several rows
    lengths: DataFrame  # index_key, chunk_pos, dl
    terms: DataFrame  # index_key, term, idf
    stats: DataFrame  # index_key, n, avgdl

    def persist(self) -> Bm25Index:
        return Bm25Index(*(df.persist() for df in (self.postings, self.lengths, self.terms, self.stats)))

    def unpersist(self) -> None:
        for df in (self.postings, self.lengths, self.terms, self.stats):
            df.unpersist()


def bm25_index(chunks: DataFrame, text: str = "text") -> Bm25Index:
    """From (index_key, chunk_pos, text). The texts are tokenised once, into a table that all parts of the index read.

    Postings stay as they stand in the texts, a row for each word: a question's terms are
    picked out first and counted then; ``counted`` sums them up for storing.
    """
    docs = chunks.select("index_key", "chunk_pos", tokens(F.col(text)).alias("toks"))
    docs = materialise(docs.withColumn("dl", F.size("toks").cast("long")), "bm25-tokens")
    lengths = docs.select("index_key", "chunk_pos", "dl")
    postings = docs.select("index_key", "chunk_pos", "dl", F.explode("toks").alias("term"), F.lit(1).cast("long").alias("tf"))
    stats = lengths.groupBy("index_key").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = docs.select("index_key", F.explode(F.array_distinct("toks")).alias("term")).groupBy("index_key", "term").agg(F.count("*").alias("df"))
    df = found.join(F.broadcast(stats), "index_key")
    raw = df.select("index_key", "term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy("index_key").agg(F.avg("raw").alias("mean"))
    terms = raw.join(F.broadcast(mean), "index_key").select("index_key", "term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(postings, lengths, terms, stats)


def counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("index_key", "chunk_pos", "dl", "term").agg(F.sum("tf").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, asked: how often the term stands in the query."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("asked"))


def bm25_scores(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, index_key, chunk_pos, score) of chunks with a query term; scores rounded to 6 places."""
    wanted = query_terms(queries).join(index.terms, "term")
    hits = index.postings.join(F.broadcast(wanted), ["index_key", "term"])  # the queries' terms are few
    hits = hits.groupBy("query_id", "index_key", "chunk_pos", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"), F.first("asked").alias("asked"), F.first("idf").alias("idf"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    rows = hits.join(F.broadcast(index.stats), "index_key")
    return rows.groupBy("query_id", "index_key", "chunk_pos").agg(F.round(F.sum(F.col("asked") * F.col("idf") * F.col("tf") * (K1 + 1) / norm), 6).alias("score"))


def _top(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("query_id", "index_key").orderBy(*order)
    # the bare row number is what Spark limits within the partitions before it sorts them together
    return scores.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).withColumn("rank", F.col("_n") - 1).drop("_n")


def bm25_top(index: Bm25Index, queries: DataFrame, k: int) -> DataFrame:
    """The k best chunks for each query and key, chunks without any term filling up; ties: the later chunk first.

    A query with fewer than k matches is filled up from the last 2 k chunks: at most k of them match.
    """
    best = _top(bm25_scores(index, queries), k, F.desc("score"), F.desc("chunk_pos")).drop("rank")
    last = Window.partitionBy("index_key").orderBy(F.desc("chunk_pos"))
    tail = index.lengths.select("index_key", "chunk_pos").withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= 2 * k).drop("_n")
    offered = tail.crossJoin(F.broadcast(queries.select("query_id"))).join(best, ["query_id", "index_key", "chunk_pos"], "left_anti").withColumn("score", F.lit(0.0))
    # a matching chunk that is not among the best has a rank of k or more, so k others stand before it
    return _top(best.unionByName(offered), k, F.desc("score"), F.desc("chunk_pos"))


def inner_product(a: Column, b: Column) -> Column:
    """In double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact search: (index_key, chunk_pos, embedding) with (query_id, qvec); ties: the earlier chunk first.

    The stated query set meets all vectors: queries are broadcast in full, vectors stream past them.
    """
    pairs = vectors.select("index_key", "chunk_pos", "embedding").crossJoin(F.broadcast(queries.select("query_id", "qvec")))
    scored = pairs.select("query_id", "index_key", "chunk_pos", F.round(inner_product(F.col("embedding"), F.col("qvec")), 6).alias("score"))
    return _top(scored, k, F.desc("score"), "chunk_pos")


def reciprocal(rank: Column) -> Column:
    return 1.0 / (DAMPING + rank + 1)


def fuse_within(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Rank fusion of two rankings of one index: rrf_score and rank, the best k. Ties: better dense rank, then sparse."""
    far = F.lit(1 << 30)
    both = dense.select("query_id", "index_key", "chunk_pos", F.col("rank").alias("dr"), F.lit(None).cast("int").alias("sr")).unionByName(sparse.select("query_id", "index_key", "chunk_pos", F.lit(None).cast("int").alias("dr"), F.col("rank").alias("sr")))
    one = both.groupBy("query_id", "index_key", "chunk_pos").agg(F.min("dr").alias("dr"), F.min("sr").alias("sr"))
    score = F.coalesce(reciprocal(F.col("dr")), F.lit(0.0)) + F.coalesce(reciprocal(F.col("sr")), F.lit(0.0))
    scored = one.withColumn("rrf_score", F.round(score, 6))
    return _top(scored, k, F.desc("rrf_score"), F.coalesce("dr", far), F.coalesce("sr", far)).select("query_id", "index_key", "chunk_pos", "rrf_score", "rank")


def fuse_across(spec: DataFrame, procedure: DataFrame) -> DataFrame:
    """Two rankings of different indexes by place alone: final_rrf and place. Ties: spec chunks first.

    Input and output rows have query_id, chunk_type, chunk_id, chunk_pos, rank and more.
    """
    both = spec.withColumn("_t", F.lit(0)).unionByName(procedure.withColumn("_t", F.lit(1)), allowMissingColumns=True).withColumn("final_rrf", reciprocal(F.col("rank")))
    w = Window.partitionBy("query_id").orderBy(F.desc("final_rrf"), "_t", "rank")
    return both.withColumn("place", F.row_number().over(w) - 1).drop("_t")


#: Chunks fetched from each kind's index, times the number wanted.
WIDE = {"spec": 4, "procedure": 2}


def search(table: DataFrame, index: Bm25Index, asked: DataFrame, k: int) -> DataFrame:
    """Both kinds' rankings, each fused within its index and then across: query_id, chunk_type, chunk_pos, rank, final_rrf, place.

    ``table``: (chunk_type, chunk_pos, embedding); ``index``: keyed by chunk type; ``asked``: (query_id, query, qvec, spec_only):
    questions for specs alone skip procedures.
    """
    ranked = {}
    for kind, times in WIDE.items():
        mine = Bm25Index(*(df.filter(F.col("index_key") == kind) for df in (index.postings, index.lengths, index.terms, index.stats)))
        own = asked if kind == "spec" else asked.filter(~F.coalesce("spec_only", F.lit(False)))
        vectors = table.filter(F.col("chunk_type") == kind).withColumnRenamed("chunk_type", "index_key")
        ranked[kind] = fuse_within(dense_top(vectors, own, times * k), bm25_top(mine, own, times * k), times * k)
    return fuse_across(ranked["spec"], ranked["procedure"]).withColumnRenamed("index_key", "chunk_type")


def keep_variant(fused: DataFrame, variant: Column) -> DataFrame:
    """After ranking: chunks without variants, or with the one asked for; all if none is asked for."""
    v = F.col("vehicle_variant")
    return fused.filter(variant.isNull() | (variant == "") | (F.size(v) == 0) | F.array_contains(v, variant))


def first_k(fused: DataFrame, k: Column | int) -> DataFrame:
    """The first k of what is left, places counted anew."""
    w = Window.partitionBy("query_id").orderBy("place")
    return fused.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") < k)


def relevant(fused: DataFrame, least: float = 0.010) -> DataFrame:
    """Queries whose best chunk scores at least ``least`` keep their chunks, others lose all."""
    best = F.max("final_rrf").over(Window.partitionBy("query_id"))
    return fused.withColumn("_best", best).filter(F.col("_best") >= least).drop("_best")
