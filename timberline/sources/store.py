"""The store: lines in Parquet by template, with small tables of templates, columns and dictionaries beside them.

``rows`` hold a template's lines as its variables, the first ``SLOTS`` in columns of their own, so that one
variable is read without the others; only lines without a template are kept as text.  They are
partitioned by ``bucket`` (template number, modulo) and sorted by template within a file, so the
template numbers that a search leaves over prune folders and row groups.  ``columns`` has a row of each
variable for every batch that was stored, and ``dictionary`` the distinct values of those variables
of the batch that repeat (kind D); both are written before the batch's lines, so no search prunes what
it does not know.
"""

from __future__ import annotations

import time
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..operators import mining

BUCKETS = 32
#: Variables of a line that have a column of their own.
SLOTS = 16
#: Lines of at most so many templates are written out as expressions.
MOST_WRITTEN = 64
#: A store whose templates, statistics and dictionaries have at most so many rows each, and bytes of files in all, is asked on the driver.
SMALL_ROWS, SMALL_BYTES = 50_000, 4 << 20
#: Lines of a template that a task writes, about.
TASK_LINES = 1 << 21


def _columns() -> list[Column]:
    return [*[F.get("vars", F.lit(i)).alias(f"v{i}") for i in range(SLOTS)], F.when(F.size("vars") > SLOTS, F.slice("vars", SLOTS + 1, 1 << 20)).alias("more")]


def write(lines: DataFrame, folder: str, min_rows: int = 2, codec: str = "zstd") -> dict[str, float]:
    """Mine templates from all lines, then store lines, templates and statistics; returns seconds by step."""
    began = time.time()
    mined = mining.with_pieces(mining.number(mining.mine(lines, min_rows)))
    mined.write.mode("overwrite").option("compression", codec).parquet(f"{folder}/templates")
    mined_at = time.time()
    append(lines, folder, codec, "overwrite")
    return {"mine": mined_at - began, "store": time.time() - mined_at}


def append(lines: DataFrame, folder: str, codec: str = "zstd", mode: str = "append") -> None:
    """Store lines under the templates that are there, and the statistics of their columns."""
    templates = lines.sparkSession.read.parquet(f"{folder}/templates")
    rows = mining.match(lines, templates).withColumn("bucket", F.pmod(F.col("eid"), F.lit(BUCKETS)))
    rows.persist()
    try:
        each = mining.distinct_values(mining.values(rows)).persist()
        meta = mining.meta_of(each)
        repeating = meta.where("kind = 'D'").select("eid", "var_idx")
        meta.write.mode(mode).option("compression", codec).parquet(f"{folder}/columns")
        held = each.join(repeating, ["eid", "var_idx"], "left_semi").select("eid", "var_idx", "value")
        held.sortWithinPartitions("eid", "var_idx", "value").write.mode(mode).option("compression", codec).parquet(f"{folder}/dictionary")
        # a template's lines are dealt to as many tasks as they need
        spread = F.pmod(F.xxhash64("line_no"), F.greatest(F.lit(1), F.expr(f"n div {TASK_LINES} + 1")))
        sized = rows.join(F.broadcast(rows.groupBy("bucket").agg(F.count("*").alias("n"))), "bucket")
        text = F.when(F.col("eid") < 0, F.col("line")).alias("text")
        kept = sized.repartition("bucket", spread).sortWithinPartitions("eid", "line_no").select("block_id", "line_no", "eid", "bucket", text, *_columns())
        kept.write.mode(mode).option("compression", codec).partitionBy("bucket").parquet(f"{folder}/rows")
        each.unpersist()
    finally:
        rows.unpersist()


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        #: What is stored of each line.
        self.stored = spark.read.parquet(f"{folder}/rows")
        self.templates = spark.read.parquet(f"{folder}/templates")
        #: Column statistics of each batch, and the distinct values of columns that repeat.
        self.bounds = spark.read.parquet(f"{folder}/columns")
        self.dictionary = spark.read.parquet(f"{folder}/dictionary")

    @cached_property
    def index(self) -> DataFrame:
        """Templates with the statistics of their columns, kept in memory for the searches of this store; ``close`` lets go of it."""
        shape = F.struct("kind", "char_mask", "max_len", "prefix", "suffix")
        cols = self.bounds.groupBy("eid").agg(F.collect_set(shape).alias("cols"))
        return self.templates.select("eid", "pieces").join(cols, "eid", "left").persist()

    @cached_property
    def small(self) -> dict[int, tuple] | None:
        """``index`` and dictionary of a small store on the driver, ``eid: (pieces, statistics, values)``; None if either bound is passed."""
        if sum(map(self._bytes, ("templates", "columns", "dictionary"))) > SMALL_BYTES:
            return None
        shape = ("kind", "char_mask", "max_len", "prefix", "suffix")
        sources = self.templates.select("eid", "pieces"), self.bounds.select("eid", *shape), self.dictionary.select("eid", "value")
        templates, bounds, values = (x.limit(SMALL_ROWS + 1).collect() for x in sources)
        if max(map(len, (templates, bounds, values))) > SMALL_ROWS:
            return None
        out: dict[int, tuple] = {r["eid"]: (r["pieces"], [], []) for r in templates}
        for r in bounds:
            if r["eid"] in out:
                out[r["eid"]][1].append(r)
        for r in values:
            if r["eid"] in out:
                out[r["eid"]][2].append(r["value"])
        return out

    def close(self) -> None:
        if "index" in self.__dict__:
            self.index.unpersist()
        for held in ("index", "small"):
            self.__dict__.pop(held, None)

    def lines_of(self, eids: list[int]) -> DataFrame:
        """``block_id, line_no, line`` of some templates' lines; of few templates, each line is one expression of its constants and variables."""
        stored = self.stored.where(F.col("bucket").isin(sorted({e % BUCKETS for e in eids})) & F.col("eid").isin(eids))
        if len(eids) > MOST_WRITTEN:
            return self.restored(stored).select("block_id", "line_no", "line")
        line = F.col("text")
        if self.small is not None:
            templates = [(e, self.small[e][0]) for e in eids if e in self.small]
        else:
            templates = self.index.where(F.col("eid").isin(eids)).select("eid", "pieces").collect()
        for eid, pieces in templates:
            parts = [F.lit(pieces[0])]
            for i, p in enumerate(pieces[1:]):
                parts += [F.col(f"v{i}") if i < SLOTS else F.get("more", F.lit(i - SLOTS)), F.lit(p)]
            line = F.when(F.col("eid") == eid, F.concat(*parts)).otherwise(line)
        return stored.select("block_id", "line_no", line.alias("line"))

    def restored(self, stored: DataFrame) -> DataFrame:
        """``block_id, line_no, eid, line, vars``; Spark broadcasts the templates if they are small."""
        pieces = self.templates.select("eid", "pieces")
        x = stored.join(pieces, "eid", "left")
        every = F.concat(F.array(*[F.col(f"v{i}") for i in range(SLOTS)]), F.coalesce("more", F.array().cast("array<string>")))
        x = x.withColumn("vars", F.when(F.col("eid") >= 0, F.slice(every, 1, F.size("pieces") - 1)))
        line = F.when(F.col("eid") >= 0, mining.filled(F.col("pieces"), F.col("vars"))).otherwise(F.col("text"))
        return x.select("block_id", "line_no", "eid", line.alias("line"), "vars", "bucket")

    @property
    def rows(self) -> DataFrame:
        return self.restored(self.stored)

    def values(self, eid: int, var_idx: int) -> DataFrame:
        """``line_no, value`` of one variable; no other column is read."""
        at = F.col(f"v{var_idx}") if var_idx < SLOTS else F.get("more", F.lit(var_idx - SLOTS))
        return self.stored.where((F.col("bucket") == eid % BUCKETS) & (F.col("eid") == eid)).select("line_no", at.alias("value"))

    @property
    def columns(self) -> DataFrame:
        """Column statistics of all lines, one row for each column; counted again where lines were appended."""
        key = ["eid", "var_idx"]
        several = self.bounds.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
        if several.isEmpty():
            return self.bounds
        again = mining.column_meta(mining.values(self.rows).join(several, key, "left_semi"))
        return self.bounds.join(several, key, "left_anti").select(*self.bounds.columns).unionByName(again)

    def lines(self) -> DataFrame:
        return self.rows.select("block_id", "line_no", "line")

    def stored_bytes(self) -> int:
        return self._bytes("")

    def _bytes(self, name: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()

    def raw_bytes(self) -> int:
        """Bytes of the lines as text, line ends included."""
        return self.lines().agg(F.sum(F.octet_length("line") + 1).alias("n")).first()["n"] or 0


def open_all(spark: SparkSession, folder: str) -> list[Store]:
    """The stores in the folders of ``folder``, in the order of their names; hidden and unreadable ones are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    out = []
    for name in sorted(x.getPath().toString() for x in found if x.isDirectory()):
        if name.rsplit("/", 1)[-1][:1] in "._":
            continue
        try:
            out.append(Store(spark, name))
        except AnalysisException:
            continue
    return out


def dump(rows: DataFrame, folder: str) -> None:
    """Raw lines as text, for looking at."""
    rows.select("line").write.mode("overwrite").text(folder)
