"""Search: prune by templates, dictionaries and column statistics, scan, verify on the line.

A template can hold a word if its constants do or one of its variables may: a variable that repeats
(kind D) by its stored distinct values, any other by its length, its characters and how the word lies
on the prefix and suffix that its values share.  Pruning only ever drops templates that cannot hold
a match; the exact filter on the whole line is always applied, so results never depend on it.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..functions.text import lex_words, python_mask
from ..sources.store import Store
from .query import And, Or, Phrase, Token, parse, read

LIMIT = 200
#: More surviving templates than this are not listed in the filter; the scan then reads all.
MOST_LISTED = 2000
#: Words of a query that dictionaries are asked for; a bit of a long each.
MOST_WORDS = 62
#: A longer word is not laid against prefixes and suffixes.
MOST_ALIGNED = 24


def words_of(node) -> list[str]:
    """The words that ``possible`` asks for."""
    if isinstance(node, And | Or):
        return list(dict.fromkeys(w for c in node.children for w in words_of(c)))
    if isinstance(node, Token):
        return [node.word]
    return list(dict.fromkeys(w for n in node.needles() for w in lex_words(n))) if isinstance(node, Phrase) else []


def possible(node, holds: Callable, lit: Callable = F.lit):
    """Whether a template can hold a match, given whether it may hold a word; a column, or with ``lit=bool`` a truth value."""
    if isinstance(node, And | Or):
        out = lit(isinstance(node, And))
        for c in node.children:
            out = out & possible(c, holds, lit) if isinstance(node, And) else out | possible(c, holds, lit)
        return out
    out = lit(True)
    for word in words_of(node):
        out = out & holds(word)
    return out


def may_hold(column: Column, word: str) -> Column:
    """Whether values of a column (a struct of its statistics) may hold the word."""
    mask = F.lit(python_mask(word))
    fits = (column["char_mask"].bitwiseAND(mask) == mask) & (column["max_len"] >= len(word))
    if len(word) > MOST_ALIGNED:
        return fits
    # the word lies in the prefix or the suffix, or what lies on neither fits between them
    free = column["max_len"] - F.length(column["prefix"]) - F.length(column["suffix"])
    parts = range(1, len(word) + 1)
    head = F.greatest(F.lit(0), F.lit(0), *[F.when(column["prefix"].endswith(word[:i]), i) for i in parts])
    tail = F.greatest(F.lit(0), F.lit(0), *[F.when(column["suffix"].startswith(word[-i:]), i) for i in parts])
    return fits & (column["prefix"].contains(word) | column["suffix"].contains(word) | (len(word) - head - tail <= free))


def may_hold_one(column: Row, word: str) -> bool:
    """``may_hold`` for the statistics of one column on the driver."""
    mask = python_mask(word)
    if column["char_mask"] & mask != mask or column["max_len"] < len(word):
        return False
    prefix, suffix = column["prefix"], column["suffix"]
    if len(word) > MOST_ALIGNED or word in prefix or word in suffix:
        return True
    parts = range(1, len(word) + 1)
    head = max((i for i in parts if prefix.endswith(word[:i])), default=0)
    tail = max((i for i in parts if suffix.startswith(word[-i:])), default=0)
    return len(word) - head - tail <= column["max_len"] - len(prefix) - len(suffix)


def _surviving_small(held: dict[int, tuple], node) -> list[int]:
    def holds_in(pieces: list[str], cols: list[Row], values: list[str]) -> Callable[[str], bool]:
        return lambda w: any(w in p for p in pieces) or any(w in v for v in values) or any(c["kind"] != "D" and may_hold_one(c, w) for c in cols)

    return [eid for eid, t in held.items() if possible(node, holds_in(*t), bool)]


def surviving(store: Store, node) -> list[int] | None:
    """Template numbers that may match, -1 (outliers) included; None if too many to list.

    The tables of a small store are asked on the driver, which saves the jobs; all others by Spark.
    """
    if store.small is not None:
        found = _surviving_small(store.small, node)
        return None if len(found) > MOST_LISTED else [-1, *sorted(found)]
    words = words_of(node)
    asked = words[:MOST_WORDS]
    listed = F.lit(0).cast("long")
    for i, w in enumerate(asked):
        listed = listed.bitwiseOR(F.when(F.col("value").contains(w), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    found = store.dictionary.select("eid", listed.alias("b")).where("b <> 0").groupBy("eid").agg(F.bit_or("b").alias("listed"))
    x = store.index.join(found, "eid", "left")

    def holds(word: str) -> Column:
        constant = F.exists("pieces", lambda p: p.contains(word))
        known = F.lit(word in asked)
        unlisted = F.exists("cols", lambda c: (~known | (c["kind"] != "D")) & may_hold(c, word))
        out = constant | F.coalesce(unlisted, F.lit(False))
        return out | F.coalesce(F.col("listed").bitwiseAND(F.lit(1 << asked.index(word))) != 0, F.lit(False)) if word in asked else out

    found = x.where(possible(node, holds)).select("eid").limit(MOST_LISTED + 1).collect()
    return None if len(found) > MOST_LISTED else [-1, *sorted(r["eid"] for r in found)]


@dataclass
class SearchResult:
    matched: DataFrame
    eids: list[int] | None
    seconds: dict[str, float] = field(default_factory=dict)
    scanned: DataFrame | None = None
    condition: Column | None = None

    def rows(self, limit: int | None = LIMIT) -> DataFrame:
        x = self.matched.select("block_id", "line_no", "line")
        return x if limit is None else x.orderBy("block_id", "line_no").limit(limit)

    def total(self) -> int:
        began = time.time()
        n = self.matched.count()
        self.seconds["count"] = time.time() - began
        return n

    def statistics(self, store: Store) -> dict[str, int]:
        """Templates and rows in all, left over by pruning, and matching; counted in one pass over what is left."""
        read_, kept = Observation("read"), Observation("kept")
        scanned = self.scanned.observe(read_, F.count(F.lit(1)).alias("n"))
        scanned.where(self.condition).observe(kept, F.count(F.lit(1)).alias("n")).select("line_no").write.format("noop").mode("overwrite").save()
        every = store.templates.count()
        return {"templates": every, "templates_left": every if self.eids is None else len(self.eids) - 1, "rows": store.stored.count(), "rows_read": read_.get["n"], "rows_matched": kept.get["n"]}


def search(store: Store, text: str, prune: bool = True, kind: str = "l") -> SearchResult:
    began = time.time()
    node = read(text, kind)
    parsed = time.time()
    eids = surviving(store, node) if prune else None
    seconds = {"parse": parsed - began, "prune": time.time() - parsed}
    rows, condition = store.lines() if eids is None else store.lines_of(eids), node.column(F.col("line"))
    return SearchResult(rows.where(condition), eids, seconds, rows, condition)


def search_all(stores: list[Store], text: str, kind: str = "l") -> SearchResult:
    """One search of several stores; the block numbers keep their lines apart."""
    found = [search(s, text, kind=kind) for s in stores]
    matched = found[0].matched
    for f in found[1:]:
        matched = matched.unionByName(f.matched)
    return SearchResult(matched, None)


def scan(lines: DataFrame, text: str, kind: str = "l") -> DataFrame:
    """The same filter over any lines."""
    return lines.where(read(text, kind).column(F.col("line")))


class Session:
    """Searches of one store; the results of the last few clauses are kept, so "A and B" starts from A."""

    def __init__(self, store: Store, keep: int = 8):
        self.store, self.keep = store, keep
        self.held: OrderedDict[tuple, DataFrame] = OrderedDict()

    def search(self, text: str) -> SearchResult:
        node = parse(text)
        parts = node.children if isinstance(node, And) else (node,)
        rows, done = self.store.lines(), 0
        for n in range(len(parts), 0, -1):
            if parts[:n] in self.held:
                rows, done = self.held[parts[:n]], n
                self.held.move_to_end(parts[:n])
                break
        for n in range(done, len(parts)):
            rows = rows.where(parts[n].column(F.col("line")))
        if done < len(parts):
            self.held[parts] = rows = rows.persist()
            while len(self.held) > self.keep:
                self.held.popitem(last=False)[1].unpersist()
        return SearchResult(rows, None)

    def close(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()
