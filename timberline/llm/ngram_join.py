"""N-gram Jaccard join: exact components of documents whose shingle sets are alike, by a size-aware heavy-light join.

A set is the distinct 64-bit hashes of a document's 3-word shingles.  Equal sets are one vertex.
For a Jaccard threshold num/den, order all shingles in one way for all sets (rare ones first: the
commonest, a bounded list counted over the whole corpus, stand last).  Then two linked sets share
a shingle among their first ``n - ceil(n * num/den) + 1``, and two among one more.

* Light (small) sets enumerate all subsets of size two of that longer prefix; a shared subset is a
  far rarer accident than a shared shingle, but their number grows with the square of the prefix.
* Heavy (large) sets enter inverted lists by each shingle of the prefix, which are scanned.

Shingles that no other prefix of a set of like size has form no keys.  Two linked sets share far more of
their prefixes than one shingle, so each entry also carries how many shared shingles the set has from
there on; an entry without enough for any partner isn't made, a key with two entries is kept only if
both have enough for each other, and two entries of a longer list meet only then.  The first key that a
linked pair shares passes this, so no link is lost, while near copies below the threshold, whose
prefixes are mostly their own, and chance pairs don't meet.

The boundary between the two is the size at which enumerating costs as much as scanning, computed
from the lists' mean length over the corpus.  Sets just below the boundary enter the lists as well.

Near copies share tens of keys.  Keys with the same vertices are one: those of two vertices name a pair,
which is compared, those of more are one list.

Scanning does not begin with all pairs of a list.  First each member is compared with the list's
leader, the most central vertex (the one with most shared keys), then with the most central one outside that
leader's component; a number of comparisons linear in the lists.  The links found give components.
Only for lists whose members are still in different components are the members of different
components compared with each other; members of one component need no comparison.  So every link
between components is found, exactly, while a large group of copies costs one comparison a member.

Defined results: null and empty texts have no shingles and link with nothing; rows that repeat a
doc_id are documents of their own with that id; documents of a null doc_id keep a null component
unless they link to others; an empty table gives an empty result; extra columns are ignored.  Equality of
shingles and sets is that of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SWEPT, components, discard, frugal, likely, press, settings, settle, unpress

WIDTH = 3
NUM, DEN = 90, 100
#: Shingles that are ordered last; bounds the broadcast to 16 bytes each.
COMMON = 1 << 18
#: A shingle is reported by a task if it is in as many of its documents.
REPORT = 2
#: Comparisons of every list with a leader before components are compared with each other.
ROUNDS = 2
#: Lists up to this length are gathered, to drop the entries without a partner there; longer ones stay whole.
GATHERED = 64
_CHUNK_WORDS = 1 << 20
_CHUNK_KEYS = 1 << 18
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _WordHash(dict):
    LIMIT = 150_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M[1]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | bytes | None, words: _WordHash, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text (or its UTF-8); fewer words than ``width`` are one shingle."""
    w = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    k = min(width, len(h))
    x = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        x = _mix(x * _M[0] + h[i : len(h) - k + 1 + i])
    return np.unique(x)


def common_shingles(docs: DataFrame, width: int = WIDTH, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles (sorted by value) and their counts; counted over all documents.

    Every task counts its shingles a stretch at a time and reports those with ``REPORT`` documents
    or more there.  Only the order of shingles depends on it, never the result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = _WordHash(), [], 0

        def counted() -> pa.RecordBatch:
            x = np.concatenate([np.empty(0, np.uint64), *held])
            held.clear()
            x.sort()
            v, c = np.unique(x[1:][x[1:] == x[:-1]], return_counts=True)
            big = c + 1 >= REPORT
            return pa.RecordBatch.from_arrays([pa.array(v[big].view(np.int64), pa.int64()), pa.array(c[big].astype(np.int64) + 1, pa.int64())], ["s", "n"])

        for batch in batches:
            for t in batch.column(0):
                x = shingle_set(t.as_py(), words, width)
                held.append(x)
                size += len(x)
                if size >= 4 * _CHUNK_WORDS:
                    yield counted()
                    size = 0
        yield counted()

    top = docs.select("text").mapInArrow(frugal(scan), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(most).toArrow()
    s = top.column("s").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], top.column("n").to_numpy().astype(np.int64)[order]


def ordered_prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The first shingles of the set in the corpus-wide order, as many as light sets need."""
    n = len(s)
    k = min(n, n - -(-n * num // den) + 2)
    values, counts = common
    if len(values):
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        known = values[at] == s
        if known.any():
            rare = s[~known]
            if len(rare) >= k:
                return rare[:k]
            often = s[known][np.argsort(counts[at[known]], kind="stable")]
            return np.concatenate((rare, often[: k - len(rare)]))
    return s[:k]


def build_sets(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id, n, v, prefix``: set size, the set's hash (the vertex) and its ordered prefix."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(common)  # COMMON entries at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHash()
        for batch in batches:
            ns, vs, ps = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), words, width)
                ns.append(len(s))
                vs.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                ps.append(ordered_prefix(s, held.value, num, den).view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(vs, pa.int64()), pa.array(ps, pa.list_(pa.int64()))], ["doc_id", "n", "v", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(frugal(scan), f"doc_id {kind}, n long, v long, prefix array<bigint>")


def size_class(num: int, den: int):
    """Column: sets of ``n`` shingles by size, so that sets of like size are in the same or the next class (a hair wider than that, for rounding)."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) * (1 + 1e-9))).cast("int")


def shared_prefixes(vertices: DataFrame, num: int, den: int) -> DataFrame:
    """``v, n, at, q``: the shingles of the prefix that another vertex of like size has in its prefix too, in order, with their positions.

    The others can take part in no link's key.  Of a shingle only counts are gathered: how many have
    it, and two 64-bit maps of their size classes (modulo 64), of those that occur and of those that
    occur an odd number of times.  Where the counts leave it open whether a class has one or more,
    the shingle stays.  A group holds one document's prefix, a tenth of its shingles.
    """
    every = vertices.select("v", "n", F.pmod(size_class(num, den), F.lit(64)).alias("c"), F.posexplode("prefix").alias("at", "s"))
    bit = "shiftleft(1L, c)"
    # rows go through the shuffles as they are: hardly any meet in a task, and what is gathered of them is longer
    held = every.select("s", "c").repartition("s").groupBy("s").agg(F.count("*").alias("m"), F.bit_or(F.expr(bit)).alias("some"), F.bit_xor(F.expr(bit)).alias("odd")).where("m > 1")
    # classes that occur an even number of times have two or more; if that explains all that are more than classes, the odd ones have one
    held = held.select("s", "some", F.expr("some & ~odd").alias("even"), F.expr("m - bit_count(some) > bit_count(some & ~odd)").alias("more"))
    near = "some & (shiftleft(1L, (c + 1) % 64) | shiftleft(1L, (c + 63) % 64))"
    x = every.join(held, "s").where(F.expr(f"more or even & {bit} <> 0 or {near} <> 0"))
    x = x.select("v", "n", "at", "s").repartition("v").groupBy("v").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("q"))
    return x.select("v", "n", F.col("q.at").alias("at"), F.col("q.s").alias("q"))


def choose_boundary(prefixes: DataFrame, num: int, den: int) -> int:
    """The largest size at which enumerating pairs of the prefix costs no more than scanning its lists.

    Cost of a key is 1; an entry of an inverted list also costs the list's mean length, seen from an
    entry, which is measured on one in 64 of the corpus's shingles.
    """
    lists = prefixes.select(F.explode("q").alias("s")).where(F.pmod("s", F.lit(64)) == 0).groupBy("s").agg(F.count("*").alias("c"))
    r = lists.agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc")).first()
    mean = r["cc"] / r["c"] if r["c"] else 1.0
    n = 1
    while n < 4096:
        p = (n + 1) - -(-(n + 1) * num // den) + 1
        if (p + 1) * p // 2 > p * (1 + mean):
            break
        n += 1
    return n


@lru_cache(1 << 16)
def least_shared(n: int, num: int, den: int) -> int:
    """The smallest number of shingles that a set of ``n`` must share, in the stored prefixes, with a partner of any size that can link."""
    m = np.arange(max(1, -(-n * num // den)), n * den // num + 1)
    beyond = np.minimum(0, 2 - -(-np.maximum(n, m) * num // den))
    return max(1, int((beyond + -(-(n + m) * num // (num + den))).min()))


def keys_of(prefixes: DataFrame, boundary: int, num: int, den: int) -> DataFrame:
    """``key, v, n, r`` of every vertex: pairs of its shared prefix if it is light, single shingles if it is heavy (or just below).

    ``r`` bounds how many shingles of its prefix the vertex can share with another if the key's are the first that they share.
    """
    low = -(-boundary * num // den)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rests, rows, made = [], [], [], 0

            def made_keys() -> pa.RecordBatch:
                row = pa.array(np.concatenate([np.empty(0, np.int64), *rows]))
                k, r = np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.int32), *rests])
                for x in (keys, rests, rows):
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64), pa.int64()), batch.column(0).take(row), batch.column(1).take(row), pa.array(r, pa.int32())], ["key", "v", "n", "r"])

            for number, (n, at, prefix) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                p = prefix.values.to_numpy(zero_copy_only=False).view(np.uint64)
                m, least = 0, least_shared(n, num, den)
                if n <= boundary and len(p) > 1:
                    i, j = np.triu_indices(len(p), 1)
                    enough = len(p) - j + 1 >= least
                    i, j = i[enough], j[enough]
                    lo, hi = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
                    keys.append(_mix(lo * _M[2] + _mix(hi * _M[3])))
                    rests.append((len(p) - j + 1).astype(np.int32))
                    m += len(i)
                if n >= low:
                    one = p[: max(0, min(len(p) - least + 1, int((at.values.to_numpy(zero_copy_only=False) <= n - -(-n * num // den)).sum())))]
                    keys.append(one)
                    rests.append(np.arange(len(p), len(p) - len(one), -1, np.int32))
                    m += len(one)
                rows.append(np.full(m, number))
                made += m
                if made >= _CHUNK_KEYS:
                    yield made_keys()
                    made = 0
            yield made_keys()

    return prefixes.select("v", "n", "at", "q").mapInArrow(frugal(scan), "key long, v long, n long, r int")


def _alike(a: str, b: str, num: int, den: int):
    return F.expr(alike(a, b, num, den))


def alike(na: str, nb: str, num: int, den: int) -> str:
    return f"least({na}, {nb}) * {den} >= greatest({na}, {nb}) * {num}"


def _enough(a: str, b: str, num: int, den: int):
    return F.expr(enough(f"n{a}", f"r{a}", f"n{b}", f"r{b}", num, den))


def enough(na: str, ra: str, nb: str, rb: str, num: int, den: int) -> str:
    """Whether ``r`` of both sides lets them share what ``plausible`` asks of their prefixes."""

    def beyond(n: str) -> str:
        return f"least(0, 2 - ({n} * {num} + {den - 1}) div {den})"

    return f"least({ra}, {rb}) >= least({beyond(na)}, {beyond(nb)}) + (({na} + {nb}) * {num} + {num + den - 1}) div {num + den}"


def group_keys(keys: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of ``keys(key, v, n, r)``, the pairs ``a, b, w`` that keys of two vertices name, and lists ``key, v, n, r, w`` of the longer ones.

    Most keys of three and more are chance: the more documents, the more often a shingle recurs in
    others that are not alike.  An entry that no other of its key is alike and has enough for is in no
    pair, so it goes, and only what is left is a list; keys of more than ``GATHERED`` stay whole.

    Near copies share tens of keys, and those with the same vertices say the same; each such set of
    vertices is kept once.  Its keys stand in the same order for all its vertices, so the first one is
    the one with the largest ``r`` of each.  ``w`` is the number of keys.  Sets go by a 64-bit hash; two
    that met in one would be a longer list, in which the same pairs meet.
    """
    of = keys.repartition("key").groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("na"), F.max("n").alias("nb"), F.min("r").alias("ra"), F.min("v").alias("a"), F.max("v").alias("b"), F.bit_xor(F.xxhash64("v")).alias("h"))
    of = of.withColumn("rb", F.col("ra")).where((F.col("c") > 2) | ((F.col("c") == 2) & _alike("na", "nb", num, den) & _enough("a", "b", num, den)))
    of = settle(of.select("key", "c", "a", "b", "h"), "shared")
    # an entry of a long key is a group of its own, so that no long list is gathered
    more = of.where("c > 2").select("key", F.expr(f"if(c > {GATHERED}, xxhash64(c, a, b, h), null)").alias("long"))
    rows = likely(keys, "key", more, "key").join(more, "key").withColumn("part", F.expr("if(long is null, null, v)"))
    x = rows.groupBy("key", "part").agg(F.first("long").alias("long"), F.sort_array(F.collect_list(F.struct("v", "n", "r"))).alias("q"))
    met = f"x.v <> y.v and {alike('x.n', 'y.n', num, den)} and {enough('x.n', 'x.r', 'y.n', 'y.r', num, den)}"
    x = x.withColumn("q", F.expr(f"if(long is null, filter(q, x -> exists(q, y -> {met})), q)")).where("size(q) > 0")
    x = settle(x.select(F.expr("coalesce(long, xxhash64(q.v))").alias("key"), "q"), "more")
    named = of.where("c = 2 and a < b").select("a", "b").union(x.where("size(q) = 2").selectExpr("q[0].v", "q[1].v"))
    twos = settle(named.groupBy("a", "b").agg(F.count("*").alias("w")), "twos")
    lists = x.where("size(q) <> 2").select("key", F.explode("q").alias("q")).select("key", "q.*")
    lists = settle(lists.groupBy("key", "v").agg(F.first("n").alias("n"), F.max("r").alias("r"), F.count("*").alias("w")), "lists")
    discard(of, x)
    return twos, lists


def plausible(pairs: DataFrame, vertices: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that their ordered prefixes allow.

    Sets that share ``need`` shingles share ``l`` among their first ``n - need + l``, for every l; the
    stored prefixes are longer than two shingles ask for, so they are held to the largest l they allow.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                need = -(-num * (na + nb) // (num + den))
                p, q = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                least = min(len(p) - na, len(q) - nb) + need
                if min(na, nb) * den < max(na, nb) * num:
                    keep.append(False)
                else:
                    keep.append(least <= 0 or len(np.intersect1d(p[: na - need + least], q[: nb - need + least], assume_unique=True)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    v = vertices.select("v", "n", "prefix")
    x = pairs.join(likely(v, "v", pairs, "a").toDF("a", "na", "pa"), "a").join(likely(v, "v", pairs, "b").toDF("b", "nb", "pb"), "b").where(_alike("na", "nb", num, den))
    return x.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(frugal(scan), "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, ids: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` of vertices that link.  ``ids(v, doc_id)`` names a document of each vertex; sets are made again for those only."""
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    named = settle(likely(ids, "v", wanted, "v").join(wanted, "v").select("v", "doc_id"), "named")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHash()
        for batch in unpress(batches):
            vs, ss = [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), words, width)
                vs.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                ss.append(s.tobytes())
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(vs, pa.int64()), pa.array(ss, pa.binary())], ["v", "got", "s"])
            yield made

    texts = press(likely(docs.select("doc_id", "text"), "doc_id", named, "doc_id").withColumnRenamed("doc_id", "key"))
    texts = texts.join(named, F.col("key").eqNullSafe(F.col("doc_id"))).select("v", "z")
    sets = texts.mapInArrow(frugal(scan), "v long, got long, s binary").where("v = got").select("v", "s")
    sets = settle(sets, "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both * den >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = pairs.join(sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")
    links = settle(x.select("a", "b", "sa", "sb").mapInArrow(frugal(compare), "a long, b long"), "links")
    discard(sets, named)
    return links


def link_components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``."""
    with settings(docs.sparkSession, SWEPT):
        return _link_components(docs, width, num, den)


def _link_components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    sets = settle(build_sets(docs, common_shingles(docs, width), width, num, den), "sets")
    some = sets.where("n > 0")
    vertices = settle(some.groupBy("v").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("m")).select("v", "m.doc_id", "m.n", "m.prefix"), "vertices")
    ids = vertices.select("v", "doc_id")
    prefixes = settle(shared_prefixes(vertices, num, den), "prefixes")
    keys = keys_of(prefixes, choose_boundary(prefixes, num, den), num, den)
    twos, lists = group_keys(keys, num, den)
    discard(prefixes)
    # central vertices lead: an original has few shingles of its own, an edited copy has some
    both = twos.select(F.col("a").alias("v"), "w").union(twos.select(F.col("b").alias("v"), "w"))
    score = both.union(lists.select("v", "w")).groupBy("v").agg(F.sum("w").alias("score"))
    label, links, tried = None, None, None
    for _ in range(ROUNDS):
        placed = lists.join(score, "v")
        if label is None:
            placed = placed.withColumn("c", F.col("v"))
        else:
            placed = placed.join(label.withColumnRenamed("id", "v"), "v", "left").withColumn("c", F.coalesce("label", "v")).drop("label")
        placed = settle(placed.select("key", "v", "n", "r", "score", "c"), "placed")
        split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("score", "v", "n", "c", "r")).alias("top")).where("lo <> hi")
        if tried is not None:
            # a list that has had its leader is led by the most central vertex outside its component
            led = split.select("key", F.col("top.c").alias("c0"))
            others = placed.join(led, "key").where("c <> c0").groupBy("key").agg(F.max(F.struct("score", "v", "n", "c", "r")).alias("top"))
            split = others
        leaders = split.select("key", F.col("top.v").alias("a"), F.col("top.n").alias("na"), F.col("top.c").alias("ca"), F.col("top.r").alias("ra"))
        star = placed.toDF("key", "v", "nb", "rb", "score", "c").join(leaders, "key").where((F.col("c") != F.col("ca")) & _alike("na", "nb", num, den) & _enough("a", "b", num, den))
        star = star.select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b"))
        star = star.union(twos.select("a", "b")).distinct() if tried is None else star.distinct().join(tried, ["a", "b"], "left_anti")
        met = settle(star, "met")
        star = settle(plausible(met, vertices, num, den), "star")
        discard(placed, met)
        found = verify(star, docs, ids, width, num, den)
        links = found if links is None else links.union(found)
        tried = star if tried is None else tried.union(star)
        label = settle(components(links), "labels")

    placed = lists.join(label.withColumnRenamed("id", "v"), "v", "left").select("key", "v", "n", "r", F.coalesce("label", "v").alias("c"))
    placed = settle(placed, "placed")
    split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    open_ = settle(placed.join(split, "key"), "open")
    discard(placed, lists, twos)
    a = open_.select("key", F.col("v").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"), F.col("c").alias("ca"))
    b = open_.select("key", F.col("v").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("c").alias("cb"))
    rest = a.join(b, "key").where("ca < cb").where(_alike("na", "nb", num, den) & _enough("a", "b", num, den))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    met = settle(rest, "met")
    rest = settle(plausible(met, vertices, num, den), "rest")
    discard(open_, met)
    if not rest.isEmpty():
        more = verify(rest, docs, ids, width, num, den)
        label = settle(components(links.union(more)), "labels")

    # tables of one row a vertex or component first, so that a large group is only ever a side of a join that can be split
    placed = settle(vertices.select("v", "doc_id").join(label.withColumnRenamed("id", "v"), "v", "left").select("v", "doc_id", F.coalesce("label", "v").alias("label")), "placed")
    least = settle(placed.groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    of = settle(placed.join(least, "label").select("v", "least"), "of")
    discard(vertices, placed, least)
    full = sets.where("n > 0").select("doc_id", "n", "v").join(of, "v").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return full.union(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
