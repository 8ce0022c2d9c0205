"""SpotSigs fingerprints: a document is the set of its spot signatures.

A spot is an anchor, a very common word, and the chain of the next ``CHAIN`` content words (words
that are no anchors) after it.  Texts short of anchors, or short altogether, have too few spots, so
every text also has the pairs of words that follow each other (the first word follows nothing) and
the character trigrams of its first word and of its unbroken runs: words of ``LONG_WORD`` characters
or more, and three or more characters between words.  All texts have the same kinds of signature, and each depends on the
words around it only, never on the size or the make-up of the whole, so texts that share a stretch
share its signatures.  Each is hashed to 32 bits; the sorted set, base64 of its little-endian bytes,
is the fingerprint, and likeness is the Jaccard coefficient of two sets.  A text of one or two
characters without a word is its own signature, so every text that holds a character has a fingerprint.

``spot_pairs`` finds all pairs of unlike fingerprints with a Jaccard coefficient of at least a
threshold: sets are partitioned by length so that partners stand in the same or the next partition,
candidates share a hash in the prefix that the threshold allows, lengths prune before the exact
comparison.

Defined results: null and empty texts have the empty fingerprint, whose likeness is 1 to itself and
0 to any other; equal texts have equal fingerprints; an empty table gives an empty result; rows that
repeat a doc_id stand next to each other in the order of their texts; a null doc_id is the smallest;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .decontam import split_words

CHAIN = 2
LONG_WORD = 17
#: Long words and what stands between words, by the word characters of ``split_words``.
RUNS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]{%d,}|[^0-9A-Za-z\x80-\U0010ffff]{3,}" % LONG_WORD)
#: Anchors: the commonest function words of the languages that the texts are in.
ANCHORS = frozenset(
    w.encode()
    for w in (
        "the a an and or of to in is it that was for on are with as at be this have from by not but what all were we when your can said "
        "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
        "le la les de des du et en un une que est pour qui dans ce il au sur se ne pas plus par avec son "
        "el los las y del por con para una su al lo como más o pero sus no si mi"
    ).split()
)


def spots(text: str | None) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's spot signatures."""
    if not text:
        return np.empty(0, np.uint32)
    w = split_words(text)
    content: list[bytes] = []
    anchors: list[tuple[bytes, int]] = []
    for x in w:
        if x in ANCHORS:
            anchors.append((x, len(content)))
        else:
            content.append(x)
    every = [crc32(x + b" " + y) for x, y in zip([b"", *w], w)]
    last = len(content) - CHAIN
    every += [crc32(a + b" " + b" ".join(content[i : i + CHAIN])) for a, i in anchors if i <= last]
    for run in [b"".join(w[:1]).decode("utf-8", "surrogatepass"), *RUNS.findall(text)]:
        t = run.lower()
        every += [crc32(t[i : i + 3].encode("utf-8", "surrogatepass")) for i in range(len(t) - 2)]
    if not every:
        every = [crc32(text.encode("utf-8", "surrogatepass"))]
    return np.unique(np.array(every, np.uint32))


def pack(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for each row of ``docs(doc_id, text)``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(spots(t.as_py())) for t in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(frugal(scan), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def spot_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs ``a, b, likeness`` of distinct non-empty fingerprints in ``prints(doc_id, fingerprint)``; a and b are the smallest ids that have them."""
    num = round(threshold * 10_000)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(base64.b64decode(f.as_py()), "<u4").astype(np.int64) for f in batch.column(1)]
            # by a second hash, so that no value range is favoured
            sets = [s[np.argsort((s * 2654435761) % (1 << 32), kind="stable")] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "s"])

    one = prints.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("doc_id").alias("id")).select("id", "fingerprint")
    x = one.mapInArrow(frugal(unpack), f"id {prints.schema['doc_id'].dataType.simpleString()}, n int, s array<bigint>")
    cut = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    x = x.withColumn("cut", cut)
    prefix = F.col("n") - F.ceil(F.col("n") * num / F.lit(10_000)).cast("int") + 1
    keys = x.select("id", "n", F.explode(F.slice("s", 1, prefix)).alias("h"), F.col("cut").alias("part"))
    up = keys.withColumn("part", F.col("part") + 1)
    a, b = keys.union(up).alias("a"), keys.alias("b")
    near = F.least("a.n", "b.n") * 10_000 >= F.greatest("a.n", "b.n") * num
    other = (F.col("a.id") < F.col("b.id")) | ((F.col("a.part") == F.col("b.part")) & (F.col("a.id") > F.col("b.id")))
    cand = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.id") != F.col("b.id")) & near & other)
    cand = cand.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    got = cand.join(x.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(x.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    like = both / (F.size("sa") + F.size("sb") - both)
    return got.select("a", "b", like.alias("likeness")).where(F.col("likeness") * 10_000 >= num)


LOWEST = -(1 << 63)


def neighbours(docs: DataFrame) -> DataFrame:
    """``part, guest, key, doc_id, z``: the documents in partitions of descending doc_id, and in each, as guest, the document after its last.

    The partition limits are ids that occur (approximate quantiles, as many as there are shuffle
    partitions), so the document after a partition's last one is known by its id and goes to both.
    Texts travel once, compressed.
    """
    spark = docs.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))
    row = ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q"), F.max("key").alias("top")).first()
    top = row["top"]
    limits = sorted(set(row["q"] or ()) - {top})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out: list[tuple] = []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                doc = d.as_py()
                key = LOWEST if doc is None else int(doc)
                z = press((t.as_py() or "").encode("utf-8", "surrogatepass"))
                part = bisect_left(limits, key)
                out.append((part, 0, key, doc, z))
                if part < len(limits) and key == limits[part]:
                    out.append((part + 1, 1, key, doc, z))
                if key == top:
                    out.append((0, 1, key, doc, z))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int32(), pa.int32(), pa.int64(), batch.schema.field(0).type, pa.binary()), strict=True)],
                ["part", "guest", "key", "doc_id", "z"],
            )

    x = docs.select("doc_id", "text").mapInArrow(frugal(scan), f"part int, guest int, key long, doc_id {kind}, z binary")
    return x.repartitionById(len(limits) + 1, "part").sortWithinPartitions("part", "guest", F.desc("key"), "z")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        held: tuple | None = None
        open_part = None
        for batch in batches:
            out: list[tuple] = []
            for p, g, d, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if open_part is not None and p == open_part and held is None:
                    continue  # further guests
                text = unpress(z.as_py()).decode("utf-8", "surrogatepass")
                own = spots(text)
                if held is not None:
                    doc, before, print_before = held
                    k = len(before) // 3
                    edited = before[: len(before) - k] + text[:k]
                    print_edited = spots(edited)
                    out.append((doc, len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(print_before), pack(print_edited), likeness(print_before, print_edited), likeness(print_before, own)))
                open_part = p
                held = None if g else (d, text, own)
            cols = zip(*out, strict=True) if out else [[]] * 7
            kinds = (batch.schema.field(3).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return neighbours(docs).mapInArrow(frugal(scan), schema)
