"""Pipeline of a training corpus: quality, language, near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import jaccard, langid, packing, quality, repeats
from matchlake.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is rejected below this probability; text without letters has probability 0.
LEAST_LANGUAGE = 0.3


def _whole(docs: DataFrame) -> DataFrame:
    """The columns of documents in one struct that travels along, beside those that a model reads."""
    return docs.select("doc_id", "text", F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), F.struct(*COLUMNS).alias("doc"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = quality.classify(_whole(docs), labels, keep=["doc_id", "doc"])
    return scored.where("predicted = 1").select("doc.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network recognises."""
    told = langid.identify(_whole(docs), keep=["doc_id", "doc"])
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at a Jaccard similarity of 0.8 or more of five-word shingles: the one with the smallest id, and of several with that id the first."""
    rows = docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id())
    stay = jaccard.first_rows(rows, F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    return rows.join(stay, "row", "left_semi").select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes in 50-byte strings of earlier ones; characters that lose some of their bytes go whole."""
    found = repeats.remove_repeats(docs.select(*COLUMNS), keep=["doc_id", "lang", "source"], as_text=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length up to 1024 tokens."""
    pieces = packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("repeats", repeats_stage), ("packing", packing_stage)]

#: Trained models and fuzzy keys have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what they hand on is written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    out = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        path = f"{out}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
