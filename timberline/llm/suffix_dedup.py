"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``WIDTH`` (100) bytes that covers it also starts earlier: in a document of
smaller id, or earlier in its own.  A string's start is a suffix; suffixes fall in buckets.

* Initial buckets: the offsets of a stretch of texts are sorted by their q-gram (``Q`` = 40 bytes); an
  offset's pointer is the place of its bucket in that order.
* Refinement: buckets of more than one are sorted by the pointers at a later offset.  Those 40 bytes
  on make them buckets of 80 bytes; the pointers so updated, 20 bytes on, make them buckets of 100.
  Buckets of one are done and never sorted again.  The members of a bucket of 100 bytes, less the
  earliest, are repeated.
* Between tasks pointers mean nothing, so there buckets are named by 64-bit identifiers, refined in
  the same way: of 80 bytes by the pair of those at 0 and 40, of 100 by the pair of that and the one at 60.
* Sampling: each 100-byte window names one of its q-grams, its anchor (the smallest by a fixed hash,
  leftmost of equals), so equal windows name equal anchors at equal offsets.  Windows in sequence
  with the same anchor are one segment, some thirty bytes apart, and only segments are exchanged.

A segment of which every window is repeated in its stretch is settled there, so a passage in very many
documents sends a row for a stretch.  The others are sorted by anchor bucket and, within it, by refined
bucket (first and last window); one that is not the first of its refined bucket is repeated as a
whole.  The first of each refined bucket is left; where an anchor bucket holds several (the edges of
repeated passages), those alone are resolved window by window with the buckets of 100 bytes.  An anchor
that is very common (found in a sample, which only decides where rows go) would gather too much
in one task: its segments are dealt by their refined bucket, and the first ones always resolved.

Equality: within a stretch that of all the window's q-grams; between tasks that of an anchor's and a
refined identifier together (128 bits), or of a window's and a second one (95 bits).

Defined results: a null text has no bytes; matches never cross documents; rows that repeat a doc_id
and its text count as one document and are each reported; rows that repeat a doc_id with other texts
are documents of their own, in an order fixed by hashes of their texts; a null doc_id is the smallest;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frugal, press, settle, unpress

WIDTH = 100
Q = 40
#: Bytes of text that a task looks at together; a longer document is looked at alone.
STRETCH = 2 << 20
LOWEST = -(1 << 63)
#: One document in so many is looked at for common anchors.
SAMPLE_EVERY = 64
#: An anchor with as many segments in the sample is common; at most ``MOST_COMMON`` are named.
COMMON = 256
MOST_COMMON = 1 << 12
_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BASE = 0x5851F42D4C957F2D
#: Random odd values of the bytes, for identifiers and for second ones.
_BYTES, _SECOND = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (7, 8))


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _A[1]
    x ^= x >> np.uint64(29)
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A[0]
    x += b * _A[2]
    return _mix(x)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base, inverse = np.full(n, np.uint64(_BASE)), np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
            base[0] = inverse[0] = np.uint64(1)
            self.up, self.down = np.cumprod(base), np.cumprod(inverse)
        return self.up[:n], self.down[:n]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... of each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def refine(grams: np.ndarray, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pointers at ``depth`` bytes of all offsets, from identifiers of their first ``width``; and whether an offset shares its bucket.

    Offsets whose next ``depth`` bytes would pass the end are told apart from none or some others.
    """
    n = len(grams)
    order = np.argsort(grams)
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(grams[order[1:]], grams[order[:-1]], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    pointer = np.empty(n, np.int64)
    pointer[order] = first
    alone = new & np.append(new[1:], True)
    active = order[~alone]
    while width < depth and len(active):
        step = min(width, depth - width)
        own, at = pointer[active], active + step
        later = np.where(at < n, pointer[np.minimum(at, n - 1)] + 1, 0)
        key = (own << 32) | later
        by = np.argsort(key)
        active, own, key = active[by], own[by], key[by]
        bucket = np.concatenate(([True], own[1:] != own[:-1]))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        place = np.arange(len(active))
        # the place of a part within its bucket, counted on from the bucket's own
        pointer[active] = own + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(bucket, place, 0))
        active = active[~(new & np.append(new[1:], True))]
        width += step
    shared = np.zeros(n, bool)
    shared[active] = True
    return pointer, shared


class Stretch:
    """Several texts side by side: identifiers of every offset's q-gram and window."""

    def __init__(self, texts: list[bytes], powers: _Powers, values: np.ndarray = _BYTES):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        self.short = n < WIDTH
        if self.short:
            return
        up, down = powers.get(n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(values[raw] * up[:n], out=s[1:])
        once = _mix((s[Q:] - s[:-Q]) * down[: n - Q + 1])
        twice = _pair(once[:-Q], once[Q:])
        self.grams = once
        self.windows = _pair(twice[: n - WIDTH + 1], once[WIDTH - Q :])

    def window_starts(self) -> np.ndarray:
        return _ranges(self.starts, np.maximum(0, self.sizes - WIDTH + 1))

    def repeated_here(self, at: np.ndarray) -> np.ndarray:
        """Which of the windows at the ascending offsets ``at`` start earlier in the stretch too."""
        pointer, shared = refine(self.grams, Q, WIDTH)
        some = at[shared[at]]
        x = np.sort((pointer[some] << 32) | some)
        again = np.zeros(len(self.grams), bool)
        again[x[1:][(x[1:] >> 32) == (x[:-1] >> 32)] & 0xFFFFFFFF] = True
        return again[at]

    def segments(self, refined_only: bool = False) -> tuple[np.ndarray, ...]:
        """text, first window, windows less one, anchor identifier, refined identifier, repeated here; of each segment."""
        none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2 + (np.empty(0, bool),)
        if self.short:
            return none
        key = (self.grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(self.grams), dtype=np.uint64)
        span, m = 1, key
        many = WIDTH - Q + 1
        while span * 2 <= many:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        rest = many - span
        m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
        at = self.window_starts()
        if not len(at):
            return none
        anchor = (m[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del key, m
        new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(anchor) != 0)))
        i = np.nonzero(new)[0]
        first, last = at[i], at[np.concatenate((i[1:], [len(at)])) - 1]
        text = np.searchsorted(self.starts, first, "right") - 1
        # empty texts share a start with the next one; the last with that start owns it
        refined = _pair(self.windows[first], self.windows[last])
        refined = _pair(refined, (last - first).astype(np.uint64))
        here = np.zeros(len(i), bool) if refined_only else np.logical_and.reduceat(self.repeated_here(at), i)
        return text, first - self.starts[text], last - first, self.grams[anchor[i]], refined, here


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes], list]]:
    """Documents a stretch at a time, in the order of their keys; of rows that repeat a key one."""
    held: dict[int, tuple[bytes, list]] = {}
    size = 0

    def ordered() -> tuple[list[int], list[bytes], list]:
        docs = sorted(held)
        return docs, [held[d][0] for d in docs], [held[d][1] for d in docs]

    for batch in batches:
        for k, key in enumerate(batch.column(0).to_pylist()):
            if key not in held:
                t = batch.column(1)[k].as_py()
                held[key] = t, [batch.column(c)[k] for c in range(2, batch.num_columns)]
                size += len(t)
            if size >= STRETCH:
                yield ordered()
                held, size = {}, 0
    if held:
        yield ordered()


def _earlier_here(bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether the same bucket stands at a smaller (doc, pos) in these arrays."""
    order = np.lexsort((pos, doc, bucket))
    b, d, p = bucket[order], doc[order], pos[order]
    first = np.concatenate(([True], b[1:] != b[:-1]))
    at = np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
    out = np.empty(len(b), bool)
    out[order] = (d != d[at]) | (p != p[at])
    return out


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.large_binary()).fill_null(b"")], ["key", "text"])


def keyed(docs: DataFrame) -> DataFrame:
    """``key long, text, doc_id`` in the order of ids: the id itself where each stands for one text, else a number of its own for each (id, text)."""
    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.col("text").cast("string").alias("text"), "doc_id")
    tag = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    clash = x.groupBy("key").agg(F.min(tag).alias("lo"), F.max(tag).alias("hi")).where("lo <> hi")
    if clash.isEmpty():
        return x
    x = x.withColumn("tag", tag)
    each = x.select("key", "tag").distinct().repartitionByRange("key", "tag").sortWithinPartitions("key", "tag")
    # range partitions are in order, so what rises within and between them does with (key, tag)
    number = settle(each.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return settle(x.join(number, ["key", "tag"]).select(F.col("number").alias("key"), "text", "doc_id"), "keyed")


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Sorted identifiers of anchors that very many segments have, from a sample of documents; at most ``MOST_COMMON``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for _, texts, _ in _stretches(_coded(batches)):
            a, c = np.unique(Stretch(texts, powers).segments(refined_only=True)[3], return_counts=True)
            keep = c > 1
            yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], ["a", "c"])

    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE_EVERY)) == 0).select("key", "text")
    top = some.mapInArrow(frugal(scan), "a long, c long").groupBy("a").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON).orderBy(F.desc("c"), "a").limit(MOST_COMMON).toArrow()
    return np.sort(top.column("a").to_numpy().astype(np.int64).view(np.uint64))


def repeated_segments(docs: DataFrame) -> DataFrame:
    """``doc, ranges``: per key the segments that are repeated, or not settled yet; packed as ``first window << 9 | common anchor << 8 | windows less one << 1 | open``."""
    held = docs.sparkSession.sparkContext.broadcast(common_anchors(docs))  # MOST_COMMON at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, common = _Powers(), held.value
        for docs_, texts, _ in _stretches(_coded(batches)):
            text, first, more, anchor, refined, here = Stretch(texts, powers).segments()
            if not len(text):
                continue
            doc = np.array(docs_, np.int64)[text]
            # a settled segment needs no bucket: it is dealt anywhere
            spread = _pair(refined ^ doc.view(np.uint64), first.astype(np.uint64))
            hot = np.isin(anchor, common)
            bucket = np.where(here, spread, np.where(hot, _pair(anchor, refined), anchor))
            packed = (first << 9) | (hot.astype(np.int64) << 8) | (more << 1) | here
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(refined.view(np.int64)), pa.array(doc), pa.array(packed)], ["a", "b", "doc", "sp"])

    x = docs.select("key", "text").mapInArrow(frugal(scan), "a long, b long, doc long, sp long")
    bucket = Window.partitionBy("a")
    x = x.withColumn("mixed", (F.min("b").over(bucket) != F.max("b").over(bucket)) | (F.col("sp").bitwiseAND(F.lit(256)) != 0))
    refined = Window.partitionBy("a", "b").orderBy("doc", "sp")
    x = x.withColumn("d0", F.first("doc").over(refined)).withColumn("s0", F.first("sp").over(refined))
    settled = (F.col("sp").bitwiseAND(F.lit(1)) == 1) | (F.col("d0") != F.col("doc")) | (F.shiftright("s0", 9) != F.shiftright("sp", 9))
    clean = F.shiftleft(F.shiftright("sp", 1), 1)
    x = x.withColumn("settled", settled).where(F.col("settled") | F.col("mixed"))
    return x.select("doc", F.when(F.col("settled"), clean).otherwise(clean + 1).alias("sp")).groupBy("doc").agg(F.collect_list("sp").alias("ranges"))


def repeated_windows(pressed: DataFrame, ranges: DataFrame) -> DataFrame:
    """``doc, windows``: of the open segments, the windows that are repeated; packed as ``first << 32 | how many << 1 | 1``.

    On their way a window not known as repeated has 31 bits of a second identifier for ``how many``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for docs_, texts, extra in _stretches(unpress(batches)):
            s = Stretch(texts, powers)
            if s.short:
                continue
            at, own = [], []
            for i, e in enumerate(extra):
                r = e[0].values.to_numpy(zero_copy_only=False)
                r = r[(r & 1) == 1]
                at.append(_ranges((r >> 9) + s.starts[i], ((r >> 1) & 127) + 1))
                own.append(np.full(len(at[-1]), i))
            at, own = np.concatenate(at), np.concatenate(own)
            doc, pos, window = np.array(docs_, np.int64)[own], at - s.starts[own], s.windows[at]
            here = _earlier_here(window, doc, pos)
            rest = np.nonzero(~here)[0]
            done = np.nonzero(here)[0]
            cut = np.concatenate(([True], (np.diff(at[done]) != 1) | (np.diff(own[done]) != 0))) if len(done) else np.empty(0, bool)
            i = np.nonzero(cut)[0]
            count = np.concatenate((i[1:], [len(done)])) - i if len(i) else np.empty(0, np.int64)
            head = done[i]
            second = (Stretch(texts, powers, _SECOND).windows[at[rest]] >> np.uint64(33)).astype(np.int64)
            key = np.concatenate((window[rest], _pair(window[head], doc[head].view(np.uint64))))
            packed = np.concatenate(((pos[rest] << 32) | (second << 1), (pos[head] << 32) | (count << 1) | 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate((doc[rest], doc[head]))), pa.array(packed)], ["a", "doc", "sp"])

    opened = ranges.where(F.exists("ranges", lambda r: r.bitwiseAND(F.lit(1)) == 1))
    x = pressed.join(opened, pressed["key"] == opened["doc"]).select("key", "z", "ranges").mapInArrow(frugal(scan), "a long, doc long, sp long")
    # dealt by the first identifier, compared by both
    x = x.repartition("a").withColumn("b", F.col("sp").bitwiseAND(F.lit(0xFFFFFFFF)))
    order = Window.partitionBy("a", "b").orderBy("doc", "sp")
    x = x.withColumn("d0", F.first("doc").over(order)).withColumn("s0", F.first("sp").over(order))
    settled = F.col("b").bitwiseAND(F.lit(1)) == 1
    again = (F.col("d0") != F.col("doc")) | (F.shiftright("s0", 32) != F.shiftright("sp", 32))
    one = F.shiftleft(F.shiftright("sp", 32), 32) + 3
    return x.where(settled | again).groupBy("doc").agg(F.collect_list(F.when(settled, F.col("sp")).otherwise(one)).alias("windows"))


def removed_spans(size: int, ranges: np.ndarray, windows: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    r = ranges[(ranges & 1) == 0]
    starts = np.concatenate((r >> 9, windows >> 32))
    ends = np.concatenate(((r >> 9) + ((r >> 1) & 127), (windows >> 32) + ((windows & 0xFFFFFFFF) >> 1) - 1)) + WIDTH
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, z in zip(starts[order].tolist(), np.minimum(ends[order], size).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        elif a < z:
            out.append([a, z])
    return [(a, z) for a, z in out]


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = keyed(docs)
    ranges = settle(repeated_segments(docs), "ranges")
    pressed = press(docs.select("key", "text", "doc_id"))
    windows = repeated_windows(pressed, ranges)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in unpress(batches):
            out: list[tuple] = []
            for text, r, w in zip(*batch.columns[1:4], strict=True):
                t = text.as_py()
                spans = removed_spans(len(t), *(x.values.to_numpy(zero_copy_only=False) if x.is_valid else none for x in (r, w)))
                h, at = hashlib.sha256(), 0
                for a, z in spans:
                    h.update(memoryview(t)[at:a])
                    at = z
                h.update(memoryview(t)[at:])
                out.append((len(t), sum(z - a for a, z in spans), len(spans), h.hexdigest(), [{"start": a, "end": z} for a, z in spans]))
            cols = zip(*out, strict=True) if out else [[]] * 5
            shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), shape), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(4), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    x = pressed.join(ranges.withColumnRenamed("doc", "key"), "key", "left").join(windows.withColumnRenamed("doc", "key"), "key", "left")
    return x.select("key", "z", "ranges", "windows", "doc_id").mapInArrow(frugal(scan), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
