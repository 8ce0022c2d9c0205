"""Shared helpers: the cluster's shared folder, durable intermediate tables, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: What a worker gets at a time while ``settle`` writes; texts are long, and a batch is held on both sides.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Shuffle files go as soon as their query has ended, not when the driver happens to collect its garbage.
SWEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session names one.

    Only a local session without one (a test) gets a temporary folder of its own; on a cluster that
    would be a folder of one machine, so there the setting is asked for.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if given:
        if not current.isDefined():
            context.setCheckpointDir(given)
        return given.rstrip("/")
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="timberline-")
    context.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_lock, _held = threading.Lock(), {}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session while any thread is in here; what the session had before comes back when the last one leaves."""
    of = tuple(values)
    with _lock:
        n, given = _held.get(of, (0, None))
        if not n:
            given = {k: spark.conf.get(k, None) for k in values}
            for k, v in values.items():
                spark.conf.set(k, v)
        _held[of] = n + 1, given
    try:
        yield
    finally:
        with _lock:
            n, given = _held[of]
            _held[of] = n - 1, given
            if n == 1:
                for k, v in given.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at durable files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with settings(spark, SMALL_BATCHES):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; whatever was made from them must be settled itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Bits of the map that ``likely`` broadcasts, 64 a row: at most 2 MB whatever is marked.
MARKS = 1 << 23


def likely(rows: DataFrame, col: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``rows`` whose ``col`` may be one of ``wanted``'s ``key``: all that are, and few others while the map is not full.

    For use before a join with ``wanted``, so that rows without a partner stay out of its shuffle.
    """
    bit = "shiftleft(1L, cast(__b % 64 as int))"
    marks = wanted.select(F.pmod(F.xxhash64(key), F.lit(MARKS)).alias("__b")).groupBy(F.expr("__b div 64").alias("__w")).agg(F.bit_or(F.expr(bit)).alias("__m"))
    seen = rows.withColumn("__b", F.pmod(F.xxhash64(col), F.lit(MARKS))).join(F.broadcast(marks), F.expr("__b div 64 = __w"))
    return seen.where(F.expr(f"__m & {bit} <> 0")).select(*rows.columns)


#: What a worker process keeps from task to task, by operator.
_memories: dict[str, object] = {}


def memory(name: str, make: Callable[[], object]) -> object:
    """Inside a task: the worker process's object of this name, kept for its next tasks."""
    if name not in _memories:
        _memories[name] = make()
    return _memories[name]


def forget(keep: str | None) -> None:
    """Inside a task: drop what the worker process keeps for other operators."""
    for name in [n for n in _memories if n != keep]:
        del _memories[name]


def hand_back() -> None:
    """Inside a task: give memory that is free back to the system; idle workers stay, and with them what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def frugal(scan: Callable, keeps: str | None = None) -> Callable:
    """A scan for ``mapInArrow`` whose worker keeps no other operator's memory and hands back what is free at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from scan(batches)
        finally:
            hand_back()

    return run


def press(rows: DataFrame) -> DataFrame:
    """Of ``rows(key, text, ...)``: ``key, z, ...``, the texts as compressed UTF-8 for their way through shuffles."""
    others = [f for f in rows.schema.fields if f.name not in ("key", "text")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            z = pa.array([squeeze((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), z, *batch.columns[2:]], ["key", "z", *batch.schema.names[2:]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.select("key", "text", *[f.name for f in others]).mapInArrow(frugal(scan), f"key {rows.schema['key'].dataType.simpleString()}, z binary{', ' + kinds if kinds else ''}")


def unpress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inside a task: batches with the texts of column 1 open again, as bytes."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            b = batch.slice(i, 128)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([open_(z.as_py()) for z in b.column(1)], pa.large_binary()), *b.columns[2:]], names=b.schema.names)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, label)``, the label being the smallest id.

    Alternating large-star and small-star steps.  Every step is a join and an aggregate that
    combines before its shuffle, so a vertex with very many links is not gathered anywhere; the
    edge list is checkpointed after each round.  Raises if it has not settled after ``max_rounds``.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint(e)

    def mark(x: DataFrame) -> tuple:
        r = x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        return r["n"], r["h"]

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        hooked = down.join(low, "u")
        small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hooked.select("u", F.col("m").alias("v")))
        e = checkpoint(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    leaf = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label")
    root = leaf.select(F.col("label").alias("id"), "label").distinct()
    return leaf.union(root)
