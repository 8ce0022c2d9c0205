"""Language identification by compression: one zstandard raw-content dictionary per language.

Learning.  From each language up to ``SAMPLE_DOCS`` labelled documents are taken (a documented bound of
the fit), those of at most ``SAMPLE_CHARS`` code points first and, among them, those of the smallest hash of their
id, and their whole texts are laid side by side until the dictionary of ``DICT_BYTES`` is full.
Nothing but text and language is kept.

Predicting.  The whole text, in lower case and with each stretch of other than letters made one
blank (as in the dictionaries), is cut into pieces of about ``PIECE`` bytes, each compressed on its own
with every dictionary (so the dictionary counts throughout a long text), and the language with the
smallest sum wins.  The margin is the saving against the runner-up as a share of the winner's sum;
a document below ``MARGIN`` is rejected.

Defined results: a null text or one without a letter is ``und`` with score 0, rejected; equal sums
go to the first language by code point; an empty table gives an empty result; without any labelled
row every text is ``und``; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import frugal

SAMPLE_DOCS = 120
SAMPLE_CHARS = 4000
MAX_LANGUAGES = 256
DICT_BYTES = 96 << 10
PIECE = 4096
MARGIN = 0.004
_OTHER = regex.compile(r"[^\p{L}]+")
#: Matches of four bytes are worth finding here, so the fast levels' parameters won't do.
_PARAMETERS = {"window_log": 17, "hash_log": 17, "chain_log": 16, "search_log": 3, "min_match": 4, "strategy": zstandard.STRATEGY_GREEDY, "write_content_size": 0, "write_checksum": 0}


def letters(text: str) -> bytes:
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """Dictionaries by language from ``labelled(doc_id, text, lang)``; the sample alone reaches the driver."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # a longer text than a dictionary holds is of no use beyond that
    whole = F.substring("text", 1, dict_bytes)
    x = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", (F.length("text") > SAMPLE_CHARS).alias("long"), h.alias("h"), whole.alias("t"))
    # the limit by group runs before the shuffle too, so a common language stays small
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "t"))).where(F.col("r") <= sample_docs)
    texts: dict[str, bytes] = {}
    for row in sorted(x.select("lang", "long", "h", "t").collect()):
        held = texts.get(row["lang"], b"")
        texts[row["lang"]] = held if len(held) >= dict_bytes else held + letters(row["t"])
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"{len(texts)} languages; the bound is {MAX_LANGUAGES}")
    return [(lang, raw[:dict_bytes]) for lang, raw in sorted(texts.items())]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], piece: int = PIECE):
        self.piece = piece
        self.langs = [k for k, _ in dictionaries]
        self.coders = []
        for _, raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given = zstandard.ZstdCompressionParameters.from_level(6, **_PARAMETERS)
            d.precompute_compress(compression_params=given)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=given).compress)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1) and margin."""
        raw = letters(text) if text and self.langs else b""
        if not raw.strip():
            return "und", 0.0, 0.0
        n = max(1, round(len(raw) / self.piece))
        step = -(-len(raw) // n)
        pieces = [raw[i : i + step] for i in range(0, len(raw), step)]
        sums = [sum(len(c(p)) for p in pieces) - 8 * len(pieces) for c in self.coders]
        best = min(range(len(sums)), key=sums.__getitem__)
        if len(sums) == 1:
            return self.langs[0], 1.0, 1.0
        rest = min(s for i, s in enumerate(sums) if i != best)
        margin = (rest - sums[best]) / max(1, sums[best])
        return self.langs[best], margin / (margin + 0.02), margin


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], margin: float = MARGIN, prefix: str = "") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred, score, margin, accepted``, each name after ``prefix`` (columns of these names are replaced)."""
    new = {prefix + "lang_pred": "string", prefix + "score": "double", prefix + "margin": "double", prefix + "accepted": "boolean"}
    keep = [c for c in docs.columns if c not in new]
    # the columns travel as one, whatever their names
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    schema = StructType([x.schema["row"]])
    for name, kind in new.items():
        schema = schema.add(name, kind)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most MAX_LANGUAGES * DICT_BYTES
    text_at = keep.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(held.value)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            got = [model.predict(t.as_py()) for t in batch.column(0).field(text_at)]
            lang, score, far = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.float64()), pa.array([f >= margin for f in far], pa.bool_())],
                names=["row", *new],
            )

    return x.mapInArrow(frugal(scan), schema).select(*[F.col("row").getField(c).alias(c) for c in keep], *new)


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted``; learned from the documents that are not held out."""
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    out = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")
