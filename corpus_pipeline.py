"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet in the shared folder and reads them back as the next one's documents.  Columns whose names
begin with two underscores are the stages' own for the while; any other column keeps its name and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm import decontam, langid, mixing, ngram_join, tokens
from timberline.llm.common import settle, table
from timberline.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with the language found; learned from all labelled ones of the stage's input.

    Each row is judged by its own text, whether its id is null or repeated.  A null text and one without a
    letter have no language and go; with no labelled row nothing can be told and all go.
    """
    found = langid.identify(docs, langid.fit(docs), prefix="__").where("__accepted")
    return found.withColumn("lang", F.col("__lang_pred")).select(*[F.col(f"`{c}`") for c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row_key`` for its columns' values: in the order of doc_id, null last, and equal for equal rows only (128-bit hashes)."""
    values = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    tags = [F.xxhash64(F.lit(salt), *values).alias(f"tag{salt}") for salt in (1, 2)]
    return docs.withColumn("__row_key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *tags))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group linked at a Jaccard similarity of 0.8 on five-word shingles.

    A null id is the greatest; of rows that repeat an id, whatever their texts, each is a document of
    its own, so one of a group's rows stays, be they equal or not.  Rows without a shingle (null, empty
    and blank texts) all stay.
    """
    keyed = _keyed(docs)
    groups = ngram_join.link_components(keyed.select(F.col("__row_key").alias("doc_id"), "text"), width=5, num=80, den=100)
    first = groups.where(F.col("doc_id") == F.col("component_id"))
    keep = first.groupBy(F.col("doc_id").alias("__row_key")).agg(F.max("n_shingles").alias("__n"))
    # rows of one key are equal
    place = F.row_number().over(Window.partitionBy("__row_key").orderBy("__row_key"))
    return keyed.join(keep, "__row_key").withColumn("__place", place).where("__n = 0 or __place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; each row is judged by its own text, whether its id is null or repeated.

    Null and empty texts have no window and stay; with an empty benchmark all stay.
    """
    keyed = _keyed(docs)
    leaks = decontam.find_leaks(keyed.select(F.col("__row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaky = leaks.where(F.size("ranges") > 0).select(F.col("doc_id").alias("__row_key"))
    return keyed.join(leaky, "__row_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: rows of one id each by their own share, equal rows together.

    A text without words, null included, has no size and is taken as often as its source's rate says;
    a source without any word is not taken.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the files of token ids hold for each document that the mix took, one row for each time.

    A null or empty text is its end id alone; rows of a null id come first.
    """
    return tokens.token_table(docs, tokenizer_path())


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_ids),
]

#: Compression and tokenizing are beyond SQL; the tests run each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
