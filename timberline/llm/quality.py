"""Quality classifier: a weak-label model and a hashed linear scorer trained on its posteriors.

Heuristic labellers look at a whole text and vote good (1), bad (-1) or nothing (0).  Expectation-
maximisation over the counts of vote patterns (all documents; at most 3 ** labellers patterns)
estimates, for either class, how often each labeller casts which vote, and the share of bad
documents; so each pattern has a posterior of being good.  A logistic scorer over hashed features
(words, shapes of words, the labellers' facts in steps) is then fitted to the posteriors of up to
``TRAIN_DOCS`` documents (chosen by hashes of their ids; a documented bound of the fit) and scores
every document.

Tables are read twice: once for the patterns and, from the sampled documents, their hashed features,
made of the whole texts where they lie (the driver gets no text); once to score.

Defined results: a null or empty text has posterior and score 0 and is not kept; equal texts, repeated
rows included, have equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

TRAIN_DOCS = 6000
#: Words come first, then shapes, then steps of facts.
WORDS, SHAPES, STEPS = 1 << 15, 1 << 10, 512
DIMENSIONS = WORDS + SHAPES + STEPS
KEEP = 0.5
_ENDS = (".", "!", "?", "…", ".\"", "»")
_RUN = re.compile(r"([^\w\s])\1\1")
_NOT_SIGNS = re.compile(r"[\w\s.,;:'’\"“”„«»()!?¿¡…\-–—/]+")


class _Words(dict):
    """What a word adds to a text: its feature, its shape's, how many letters; and, unless it is of small letters only, how many capitals, digits, signs, runs of a sign, and whether it has no letter or digit."""

    LIMIT = 200_000

    def __missing__(self, w: str) -> tuple[int, int, int, tuple[int, int, int, int, int] | None]:
        if len(self) >= self.LIMIT:
            self.clear()
        if w.isalpha():
            if w.islower():
                v = self[w] = (crc32(w.encode()) % WORDS, _SHAPE["l", len(w) // 2, ""], len(w), None)
                return v
            letters, other, more = len(w), "", (sum(map(str.isupper, w)), 0, 0, 0, 0)
        else:
            letters, digits = sum(map(str.isalpha, w)), sum(map(str.isdigit, w))
            other = "".join([ch for ch in w if not ch.isalpha()])[:4]
            other = "d" if other.isdigit() else other
            upper = 0 if w.islower() else sum(map(str.isupper, w))
            more = (upper, digits, len(_NOT_SIGNS.sub("", w)), len(_RUN.findall(w)), int(not any(map(str.isalnum, w))))
        shape = _SHAPE["U" if w[:1].isupper() else "l", len(w) // 2, other]
        v = self[w] = (crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS, shape, letters, more)
        return v


class _Shapes(dict):
    def __missing__(self, key: tuple[str, int, str]) -> int:
        if len(self) >= 10_000:
            self.clear()
        v = self[key] = WORDS + crc32(f"{key[0]}{min(9, key[1])}{key[2]}".encode("utf-8", "surrogatepass")) % SHAPES
        return v


_words, _SHAPE = _Words(), _Shapes()


def _facts(text: str, w: list[str], counts: Counter, known: list[tuple]) -> dict[str, float]:
    """``known``: of each word of ``counts`` what it adds and how often it occurs."""
    n, chars = max(1, len(w)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = upper = digits = signs = runs = bare = 0
    for k, times in known:
        letters += k[2] * times
        more = k[3]
        if more:
            upper += more[0] * times
            digits += more[1] * times
            signs += more[2] * times
            runs += more[3] * times
            bare += more[4] * times
    return {
        "n": len(w),
        "letters": letters / max(1, sum(map(len, w))),
        "signs": signs / n,
        "same": sum(map(eq, w, w[1:])) / n,
        "distinct": len(counts) / n,
        "top": max(counts.values()) / n if w else 1.0,
        "bare": bare / n,
        "ends": sum([x.rstrip().endswith(_ENDS) for x in lines]) / max(1, len(lines)),
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "length": letters / n,
        "upper": upper / max(1, letters),
        "runs": runs / n,
        "digits": digits / chars,
    }


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


#: Each labeller: the facts of a text to a vote.  The limits are those of running prose in alphabetic scripts.
LABELLERS = (
    ("letters", lambda f: _vote(f["letters"] < 0.8, f["letters"] > 0.93)),
    ("signs", lambda f: _vote(f["signs"] > 0.25, f["signs"] < 0.02)),
    ("same", lambda f: _vote(f["same"] > 0.25, f["same"] < 0.02)),
    ("distinct", lambda f: _vote(f["n"] > 30 and f["distinct"] < 0.15, f["distinct"] > 0.35)),
    ("top", lambda f: _vote(f["n"] > 20 and f["top"] > 0.2, f["n"] > 20 and f["top"] < 0.12)),
    ("bare", lambda f: _vote(f["bare"] > 0.15, False)),
    ("ends", lambda f: _vote(f["ends"] < 0.2, f["ends"] > 0.7)),
    ("lines", lambda f: _vote(f["lines"] > 0.5, f["lines"] < 0.1)),
    ("length", lambda f: _vote(f["length"] < 2.5 or f["length"] > 14, 3.5 < f["length"] < 8)),
    ("upper", lambda f: _vote(f["upper"] > 0.5, f["upper"] < 0.2)),
    ("runs", lambda f: _vote(f["runs"] > 0.15, False)),
    ("short", lambda f: _vote(f["n"] < 3, f["n"] > 50)),
    ("digits", lambda f: _vote(f["digits"] > 0.15, f["digits"] < 0.02)),
)


def examine(text: str | None, features: bool = True) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Votes, and hashed features of the whole text if they are wanted: indexes and values."""
    if not text:
        return [0] * len(LABELLERS), np.empty(0, np.int64), np.empty(0)
    w = text.split()
    counts = Counter(w)
    known = list(zip(map(_words.__getitem__, counts), counts.values()))
    f = _facts(text, w, counts, known)
    cast = [v(f) for _, v in LABELLERS]
    if not features:
        return cast, np.empty(0, np.int64), np.empty(0)
    n, total = max(1, len(counts)), max(1, len(w))
    word, shape = {k[0] for k, _ in known}, {}
    for k, c in known:
        shape[k[1]] = shape.get(k[1], 0) + c
    keys, vals = [*word, *shape], [1 / n**0.5 / 4] * len(word) + [v / total for v in shape.values()]
    for i, (k, v) in enumerate(sorted(f.items())):
        if k != "n":
            keys.append(WORDS + SHAPES + i * 20 + int(min(9, max(0, v * 10))))
            vals.append(0.5)
    return cast, np.array(keys, np.int64), np.array(vals)


def votes(text: str | None) -> list[int]:
    return examine(text, features=False)[0]


class LabelModel:
    """Two classes; for each class and labeller the chances of its three votes."""

    def __init__(self, counts: dict[tuple[int, ...], int], rounds: int = 60):
        k = len(LABELLERS)
        self.share_good = 0.8
        # a labeller starts out right rather than wrong: bad, none, good for the classes bad, good
        self.chance = np.tile(np.array([[[0.35, 0.45, 0.2]], [[0.05, 0.35, 0.6]]]), (1, k, 1))
        if not counts:
            return
        p = np.array(sorted(counts), int) + 1
        n = np.array([counts[tuple(x - 1)] for x in p], float)
        hot = np.eye(3)[p]
        for _ in range(rounds):
            g = self._posterior(p)
            for c, w in ((0, n * (1 - g)), (1, n * g)):
                seen = np.einsum("i,ikv->kv", w, hot) + np.array([0.5, 0.5, 0.5])
                self.chance[c] = seen / seen.sum(1, keepdims=True)
            self.share_good = float(np.clip((n * g).sum() / n.sum(), 0.01, 0.99))

    def _posterior(self, p: np.ndarray) -> np.ndarray:
        k = np.arange(p.shape[1])
        bad = np.log(self.chance[0][k, p]).sum(1) + np.log(1 - self.share_good)
        good = np.log(self.chance[1][k, p]).sum(1) + np.log(self.share_good)
        return 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))

    def posterior(self, v: list[list[int]]) -> np.ndarray:
        return self._posterior(np.array(v, int) + 1) if v else np.empty(0)

    def accuracies(self) -> dict[str, float]:
        """Chance that a vote, when cast, is right."""
        b, g = self.chance
        share = np.array([1 - self.share_good, self.share_good])
        right = share[0] * b[:, 0] + share[1] * g[:, 2]
        wrong = share[0] * b[:, 2] + share[1] * g[:, 0]
        return {name: float(r / (r + w)) for (name, _), r, w in zip(LABELLERS, right, wrong, strict=True)}


class Scorer:
    """Logistic regression on hashed features."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        self.w, self.b = (np.zeros(DIMENSIONS) if weights is None else weights), bias

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, rate: float = 0.3) -> Scorer:
        """Adaptive gradient steps over all ``examples`` (indexes, values) at once."""
        if not examples:
            return self
        keys, vals = np.concatenate([k for k, _ in examples]), np.concatenate([v for _, v in examples])
        row = np.repeat(np.arange(len(examples)), [len(k) for k, _ in examples])
        square, square_b = np.full(DIMENSIONS, 1e-8), 1e-8
        for _ in range(rounds):
            logit = np.bincount(row, self.w[keys] * vals, len(examples)) + self.b
            g = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - target) / len(examples)
            step = np.bincount(keys, g[row] * vals, DIMENSIONS) + 1e-6 * self.w
            square += step * step
            self.w -= rate * step / np.sqrt(square)
            square_b += g.sum() ** 2
            self.b -= rate * g.sum() / square_b**0.5
        return self

    def score(self, keys: np.ndarray, vals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.w[keys] @ vals + self.b, -50, 50)))) if len(keys) else 0.0


def survey(docs: DataFrame, sample: int = TRAIN_DOCS) -> tuple[dict[tuple[int, ...], int], list[tuple[list[int], np.ndarray, np.ndarray]]]:
    """Counts of vote patterns over all documents with a text; votes and features of those sampled, in the order of hashes of their ids."""
    some = docs.where("length(text) > 0")
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # about as many as wanted by a hash of the id first, so that no task sends more than its share
    picked = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, some.count()))) < int(1.2 * sample), F.lit(False))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            seen: Counter = Counter()
            rows: list[tuple] = []
            for t, key, pick in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                v, keys, vals = examine(t.as_py(), bool(pick))
                p = "".join("-0+"[x + 1] for x in v)
                seen[p] += 1
                if pick:
                    rows.append((p, 0, key, keys, vals.astype(np.float32)))
            rows += [(p, n, None, None, None) for p, n in seen.items()]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["p", "n", "h", "keys", "vals"])

    x = some.select("text", h.alias("h"), picked.alias("pick")).mapInArrow(frugal(scan), "p string, n long, h string, keys array<long>, vals array<float>")
    # one row for each pattern, and one for each sampled document
    x = x.groupBy("p", "h", "keys", "vals").agg(F.sum("n").alias("n"), F.count("*").alias("times"))
    counts: dict[tuple[int, ...], int] = {}
    taken = []
    decode = lambda p: tuple("-0+".index(ch) - 1 for ch in p)
    for batch in x.toArrow().to_batches():
        for p, hash_, keys, vals, n, times in zip(*(batch.column(c) for c in ("p", "h", "keys", "vals", "n", "times")), strict=True):
            if not hash_.is_valid:
                counts[decode(p.as_py())] = n.as_py()
            else:
                k, v = keys.values.to_numpy(), vals.values.to_numpy().astype(float)
                taken += [(hash_.as_py(), p.as_py(), k.tobytes(), k, v)] * times.as_py()
    taken.sort(key=lambda x: x[:3])
    return counts, [(list(decode(p)), k, v) for _, p, _, k, v in taken[:sample]]


def train(docs: DataFrame, sample: int = TRAIN_DOCS) -> tuple[LabelModel, Scorer]:
    counts, taken = survey(docs, sample)
    model = LabelModel(counts)
    return model, Scorer().fit([(k, v) for _, k, v in taken], model.posterior([v for v, _, _ in taken]))


def classify(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """``doc_id, posterior, score, keep`` for every row of ``docs(doc_id, text)``; keep is score >= ``keep``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    model, scorer = train(docs)
    held = docs.sparkSession.sparkContext.broadcast((model, scorer))  # of fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = held.value
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            seen = [examine(t.as_py()) for t in batch.column(1)]
            post = np.where([len(k) > 0 for _, k, _ in seen], m.posterior([v for v, _, _ in seen]), 0.0)
            score = np.array([s.score(k, v) for _, k, v in seen], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(post, pa.float64()), pa.array(score), pa.array(score >= keep)], ["doc_id", "posterior", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(frugal(scan), f"doc_id {kind}, posterior double, score double, keep boolean")
