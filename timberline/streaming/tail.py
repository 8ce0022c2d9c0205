"""An extension: searching and storing lines as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.query import parse
from ..sources import store


def lines(spark: SparkSession, folder: str) -> DataFrame:
    x = spark.readStream.option("lineSep", "\n").text(folder)
    return x.select(F.xxhash64(F.col("_metadata.file_path")).alias("block_id"), F.xxhash64("value").alias("line_no"), F.col("value").alias("line"))


def matching(stream: DataFrame, query: str) -> DataFrame:
    return stream.where(parse(query).column(F.col("line")))


def into_store(stream: DataFrame, folder: str, state: str) -> StreamingQuery:
    """Append each batch under the store's templates; equal lines keep numbers of their own (batch, then place in it)."""

    def put(batch: DataFrame, n: int) -> None:
        store.append(batch.withColumn("line_no", F.lit(n << 46) + F.monotonically_increasing_id()), folder)

    return stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
