"""A pipeline over ``documents``: each stage's output is stored and read again by the next.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm import bpe, language, mixing, ngram_join, suffix_dedup
from bazaar.llm.shared import store

BLOCK_TOKENS = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned stay: null texts and texts without letters go.

    Repeated rows and null ids stay as they are; an empty table stays empty, and
    so does one without any lang to learn from.  Columns besides those of
    ``documents`` go here, whatever their names.
    """
    found = language.identify_languages(docs, carry=COLUMNS[1:])
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Rows without an id stay if no linked document has one, of rows that share id
    and shingles one stays, and documents without words all stay.
    """
    return ngram_join.keep_first(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out.

    A cut inside a character takes the rest of the character along.  Documents
    of which nothing is left go.  Rows without an id count as later than all
    others, and rows of one id remove nothing from each other.
    """
    found = suffix_dedup.remove_repeats(docs, carry=["lang", "source"], as_text=True)
    left = found.withColumnRenamed("kept", "text").where(F.col("text") != "")
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it.

    Null sources are one source; documents without a word are never taken, and
    rows that are alike in all columns share what is taken of them.
    """
    order = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    marked = docs.select(*COLUMNS, F.xxhash64(order, *COLUMNS).alias("row_key"))
    found = mixing.mix_sources(marked, carry=["row_key"]).where("taken > 0")
    # Rows with one key are alike, so it does not matter which of them is taken.
    times = found.groupBy("row_key").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("times"))
    once = marked.dropDuplicates(["row_key"])
    taken = once.join(times, "row_key").withColumn("turn", F.explode(F.sequence(F.lit(1), "times")))
    return taken.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of every row, and digests of its ids and of the bytes they decode to.

    Null texts count as empty, repeated rows stay repeated, and an empty table
    gives an empty one.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # Executors are well filled by the stages before: small blocks.
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, block_tokens=BLOCK_TOKENS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

# Components, best cosines and merges of tokens are beyond SQL; tests compare a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
