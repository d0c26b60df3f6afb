"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage is a function of (spark, docs, sf_dir) on what its predecessor kept;
``run`` writes each stage's rows and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lines, neardup, pieces
from tidemark.llm import toxicity as tox
from tidemark.llm.base import read, without, written

#: Documents in which a line must stand to be boilerplate; words and similarity of near copies.
LINE_DOCS, SHINGLE_WORDS, SIMILARITY = 10, 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects; it is fitted on the labelled rows of docs."""
    return without(docs, tox.toxicity(docs, read(spark, sf_dir, "labels")).filter("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that stand in at least LINE_DOCS documents, keeps the first occurrence only.

    Documents that lose their whole text go; n_chars follows the text.
    """
    cut = lines.apply(docs, lines.line_bitmaps(docs, LINE_DOCS, keep_first=True))
    left = cut.filter((F.col("n_dropped") == 0) | (F.length("text") > 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document of smallest id."""
    return without(docs, neardup.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY).filter("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return without(docs, decontam.contaminated(docs, read(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens with merge dropout, and the size and hash of the text that they restore."""
    return pieces.encode(docs, restored=True)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece", tokenize),
]
#: The classifier and the seeded tokens have no SQL form; tests hold the stages' operators against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("tokens_hash"), "n_bytes", "text_sha256")
