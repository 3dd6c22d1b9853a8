"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import oracles


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-Pair token shards of all documents, read back: one row per document."""
    from specloom.llm import repair
    from specloom.llm.tokens import definition

    shards = repair.write_shards(read(spark, sf_dir, "documents"), definition(tokenizer_file()))
    return repair.read_documents(shards)


def op2_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures of all documents and the cascade's verdict. Which rule spoke first depends on measured costs, so it is left out."""
    from specloom.llm import quality

    return quality.judge(read(spark, sf_dir, "documents")).drop("rejected_by")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, rendered and read back."""
    from specloom.llm import chat

    odd = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.read_back(chat.render(turns))


def op6_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' places in a mixture of the sources, their sizes to the power of 0.7 as target weights."""
    from specloom.llm import pfair

    return pfair.schedule(read(spark, sf_dir, "documents"))


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near duplicates and its number of links."""
    from specloom.llm import lsh_forest

    return lsh_forest.join(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's stages, the last one's rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in windows of the benchmark's items, and where these stand in the original text."""
    from specloom.llm import decontaminate

    found = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.digest(F.col("items")).alias("items_sha256"), "contaminated", F.size("spans").cast("long").alias("n_spans"), chars.alias("span_chars"))


def op3_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram of all documents with its suffix sums."""
    from specloom.llm import lengths
    from specloom.llm.tokens import definition

    counted = lengths.token_lengths(read(spark, sf_dir, "documents"), definition(tokenizer_file()))
    return lengths.histogram(counted)


def op5_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 13-word windows of earlier documents, by fixed-block anchors."""
    from specloom.llm import anchors

    return anchors.remove_repeats(read(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial-matching scores of all documents next to a unigram base."""
    from specloom.llm import ppm

    return ppm.score(read(spark, sf_dir, "documents"))


def op10_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 400-byte strings that start twice, by a logarithmic family of suffix arrays."""
    from specloom.llm import suffix_family

    return suffix_family.remove_repeats(read(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_seen")


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_suffix_family`` without the column that SQL cannot express."""
    return op10_suffix_family(spark, sf_dir).drop("longest_seen")


QUERIES = {f.__name__: f for f in (op1_repair, op2_cascade, op3_lengths, op4_chat, op5_anchors, op6_pfair, op7_ppm, op8_automaton, op9_forest, op10_suffix_family, pipeline, repeated_bytes)}
SQL: dict[str, str] = {"op2_cascade": oracles.CASCADE, "op4_chat": oracles.CHAT, "op5_anchors": oracles.ANCHORS, "op8_automaton": oracles.AUTOMATON, "op9_forest": oracles.FOREST, "repeated_bytes": oracles.REPEATED_BYTES}
