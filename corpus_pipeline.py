"""Corpus pipeline: reject poor documents, keep one of each group of near duplicates, cut benchmark passages,
mask secrets, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it; all but
the last keep the columns of ``documents``.

Defined results of odd rows: null, empty and wordless texts all have one quality score, that of no features, and go with the
poor documents if it is below the cut (with the given labels it is; without labels of both kinds nothing goes). The other stages
keep them. Rows are judged one by one, so ids may be null or repeated: the near-duplicate stage drops a row only
if another of its group of texts stays. Columns other than those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm.decontaminate import find_contamination
from headwater.llm.ngram_jaccard import drop_near_duplicates
from headwater.llm.quality import CUT, score_quality
from headwater.llm.scratch import materialize
from headwater.llm.secrets import redacted, scan_secrets
from headwater.llm.sentencepiece import encode_sentencepiece

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).filter(F.col("score") >= CUT).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each component of five-word shingle links of 0.8 or more."""
    return drop_near_duplicates(docs.select(COLUMNS), width=5, numerator=80, denominator=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the merged spans of benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark, cut=True, keep=["lang", "source", "n_chars"])
    return _with_text(found.withColumnRenamed("clean_text", "text"), F.col("text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret span masked."""
    return _with_text(scan_secrets(docs), redacted())


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    return encode_sentencepiece(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("SentencePiece encoding", sentencepiece),
]

#: SQL can't express the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
