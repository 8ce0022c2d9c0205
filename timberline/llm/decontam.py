"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, so on UTF-8 bytes a table
turns every other byte into a blank.  The patterns are the windows of ``width`` consecutive words of
the items (an item of fewer words is one window).  For all patterns of one length m: the shift
table gives, for the last block of words (two, or one if m is 1) at the current position, how far
the search may jump; a block that no pattern holds allows m - 1 words, so nearly all positions
are never looked at.  Where the shift is 0, the hash bucket of that suffix block lists the patterns
that end so, and a direct comparison confirms each.

The items are dealt by a hash into parts of about ``PART_BYTES``, each read by the driver by itself,
broadcast and searched in its own pass, so no broadcast grows with the benchmark; a document's hits
from several parts are merged by its row.

Defined results: a null or empty text has no words, no hits and the digest of an empty list; items
without words never match; equal items both count; a null item_id is written as an empty string in
lists; extra columns of either table are ignored.  Rows that repeat a doc_id are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

WIDTH = 10
#: Bytes of item text in one part.
PART_BYTES = 8 << 20
_BLANK = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BLANK).split() if text else []


class WuManber:
    """Search tables for the windows of ``items``: (item_id as string, text) pairs."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = split_words(text)
            m = min(width, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                owners.setdefault(tuple(w[i : i + m]), set()).add(item)
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for p in owners:
            by_length.setdefault(len(p), []).append(p)
        self.tables = []
        for m, patterns in sorted(by_length.items()):
            b = min(2, m)
            shift: dict = {}
            bucket: dict = {}
            for p in patterns:
                for end in range(b, m + 1):
                    block = (p[end - 2], p[end - 1]) if b == 2 else p[end - 1]
                    shift[block] = min(shift.get(block, m), m - end)
                block = (p[-2], p[-1]) if b == 2 else p[-1]
                bucket.setdefault(block, {}).setdefault(p[0], []).append((p, frozenset(owners[p])))
            self.tables.append((m, b, m - b + 1, shift, bucket))

    def search(self, w: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Half-open word ranges inside occurrences (sorted, disjoint), and the items that occur."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        n = len(w)
        for m, b, far, shift, bucket in self.tables:
            at = shift.get
            i = m - 1
            while i < n:
                block = (w[i - 1], w[i]) if b == 2 else w[i]
                s = at(block, far)
                if s:
                    i += s
                    continue
                first = i - m + 1
                for p, own in bucket[block].get(w[first], ()):
                    if tuple(w[first : i + 1]) == p:
                        found.append((first, i + 1))
                        items |= own
                i += 1
        found.sort()
        ranges: list[list[int]] = []
        for a, z in found:
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], z)
            else:
                ranges.append([a, z])
        return ranges, items


def _parts(benchmark: DataFrame) -> Iterator[tuple[int, list[tuple[str, str | None]]]]:
    """The number of parts and, one after the other, each part's items; the driver reads one at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // PART_BYTES))
    for i in range(n):
        yield n, [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows ``doc_id, n_words, ranges array<array<int>>, items array<string>`` for each row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row string, n_words long, ranges array<array<int>>, items array<string>"
    keyed = docs.select("doc_id", "text")
    context = docs.sparkSession.sparkContext

    def one(part: list, many: bool) -> DataFrame:
        held = context.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wm = WuManber(held.value, width)
            for batch in batches:
                out: list[tuple] = []
                for text in batch.column(1):
                    t = text.as_py()
                    w = split_words(t)
                    ranges, items = wm.search(w)
                    tag = hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() if many else ""
                    out.append((tag, len(w), ranges, sorted(items)))
                cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.list_(pa.int32()))), pa.array(cols[3], pa.list_(pa.string()))],
                    ["doc_id", "row", "n_words", "ranges", "items"],
                )

        return keyed.mapInArrow(frugal(scan), schema)

    every, n = None, 1
    for n, part in _parts(benchmark):
        found = one(part, n > 1)
        every = found if every is None else every.unionByName(found)
    if n == 1:
        return every.drop("row")
    merged = every.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.count("*").alias("n"), F.flatten(F.collect_list("ranges")).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        F.array_sort("all"),
        F.array().cast("array<array<int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= x[0]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], x[1])))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    # rows that repeat (doc_id, text) come back as often as they were
    copies = F.explode(F.sequence(F.lit(1), (F.col("n") / n).cast("int")))
    return merged.withColumn("ranges", joined).withColumn("__k", copies).select("doc_id", "n_words", "ranges", "items")


def leak_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return find_leaks(docs, benchmark, width).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH low AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s, w FROM low WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS p FROM win),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT m FROM pat),
dwin AS (SELECT doc_id, m, unnest(generate_series(1, len(w) - m + 1)) AS s, w FROM dw, lens WHERE len(w) >= m),
occ AS (SELECT d.doc_id, d.s, d.m, p.item_id FROM dwin d JOIN pat p ON p.m = d.m AND p.p = array_to_string(d.w[d.s:d.s + d.m - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
