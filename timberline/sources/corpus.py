"""Lines as DataFrames: text files, and the driver's tables written as log lines.

Every corpus has ``block_id, line_no, line``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_LINES = 2500
BLOCK_BYTES = 64 << 20
#: Lines of one text that keep numbers of their own.
TEXT_LINES = 10_000_000
TURNS = 100_000
LINE_NUMBERS = 100


def read_text(spark: SparkSession, paths: str | Sequence[str], min_bytes: int = 0, skip_bad: bool = False) -> DataFrame:
    """Lines of text files; only ``\\n`` ends a line, an unended last line counts, ``\\r`` is kept.

    ``line_no`` rises with the place in the input; files of at most ``min_bytes`` are left out, and with
    ``skip_bad`` what cannot be read of a damaged one.  A block is a stretch of ``BLOCK_BYTES`` or less of a file,
    as a task reads it.
    """
    x = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", str(skip_bad).lower()).text(list(paths) if not isinstance(paths, str) else paths)
    meta = F.col("_metadata")
    x = x.select(meta["file_path"].alias("file"), meta["file_size"].alias("bytes"), F.floor(meta["file_block_start"] / BLOCK_BYTES).alias("stretch"), F.col("value").alias("line"))
    x = x.where(F.col("bytes") > min_bytes).withColumn("line_no", F.monotonically_increasing_id())
    return x.select(F.xxhash64("file", "stretch").alias("block_id"), "line_no", "line")


def numbered(folder: str, first: int, last: int) -> list[str]:
    return [f"{folder}/{n}.log" for n in range(first, last + 1)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _block(line_no: Column) -> Column:
    return F.floor(line_no / BLOCK_LINES).cast("long")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("ts").cast("string"), F.lit(" "), F.upper("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="), F.col("value").cast("string"), F.lit(" props:"), F.col("props"))
    return _table(spark, sf_dir, "events").select(_block(F.col("event_id")).alias("block_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("order="), F.col("o_orderkey").cast("string"), F.lit(" cust="), F.col("o_custkey").cast("string"), F.lit(" status:"), F.col("o_orderstatus"), F.lit(" prio="), F.col("o_orderpriority"))
    return _table(spark, sf_dir, "orders").select(_block(F.col("o_orderkey")).alias("block_id"), F.col("o_orderkey").alias("line_no"), line.alias("line"))


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = (("ship=", "l_shipdate"), (" order=", "l_orderkey"), (" line=", "l_linenumber"), (" part=", "l_partkey"), (" flag:", "l_returnflag"), (" status:", "l_linestatus"), (" qty=", "l_quantity"), (" price=", "l_extendedprice"))
    line_no = F.col("l_orderkey") * LINE_NUMBERS + F.col("l_linenumber")
    line = F.concat(*[x for word, name in said for x in (F.lit(word), F.col(name).cast("string"))])
    return _table(spark, sf_dir, "lineitem").select(_block(line_no).alias("block_id"), line_no.alias("line_no"), line.alias("line"))


def _pieces(df: DataFrame, key: Column, text: str) -> DataFrame:
    x = df.select(key.alias("k"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return x.select(F.col("k").alias("block_id"), (F.col("k") * TEXT_LINES + F.col("i")).alias("line_no"), "line")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(_table(spark, sf_dir, "documents"), F.col("doc_id"), "text")


def conv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(_table(spark, sf_dir, "conversations"), F.col("conv_id") * TURNS + F.col("turn"), "text")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(_table(spark, sf_dir, "pages"), F.col("page_id"), "html")


CORPORA = {"events": events_log, "orders": orders_log, "lineitem": lineitem_log, "docs": doc_lines, "conversations": conv_lines, "pages": page_lines}
