"""Token-ID output: an adaptive context-mixing range coder over ids, in files of independent blocks.

Model.  An id is coded in one arithmetic-coding step from a mixture of three predictions: order 0
(adaptive counts of all ids), order 1 and order 2 (the id that last followed the previous one, or
the previous two, with a confidence).  The weights of the mixture are learned online for each
combination of confidences and agreement.  All arithmetic is in integers, so the decoder repeats it.

Speed.  A block is cut into lanes of ``STEPS`` ids; all lanes share the block's model and advance
together, so each step codes thousands of ids with a few array operations.  The model is reset for
each block and every block carries the crc32 of its ids, so any block can be read without another.

File: ``magic, header length, header (JSON), index, blocks``.  The index holds ids and lengths of the
documents; the header the counts and the crc32 of the index.

Defined results: a null or empty text yields only the end id; rows that repeat a doc_id are all
written, in the order of their texts; a null doc_id comes first; an empty table gives no files and
an empty result; extra columns are ignored.  A damaged block or index raises ``ValueError``.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frugal, memory, scratch

MAGIC = b"IDMIX001"
VOCABULARY = 49408
END_ID = 2
STEPS = 128
BLOCK_IDS = 8192 * STEPS
#: Ids in one file, about.
FILE_IDS = 6 * BLOCK_IDS
_SCALE = 1 << 18
_PARTS = 64
_BITS = 24
_SLOTS = 1 << 18
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_U16, _U48, _UBITS = np.uint64(16), np.uint64(48), np.uint64(_BITS)
_REBUILD = 4


class Mixture:
    """The shared adaptive model of a block."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size, np.int64)
        # the id that followed, times 4, plus the confidence (0 to 3)
        self.next1, self.next2 = np.zeros(size, np.int32), np.zeros(_SLOTS, np.int32)
        self.seen, self.hits2, self.hits1 = np.full(32, 8, np.int64), np.full(32, 2, np.int64), np.full(32, 1, np.int64)
        self.waiting: list[np.ndarray] = []
        self.rebuild()

    def rebuild(self) -> None:
        for x in self.waiting:
            self.counts += np.bincount(x, minlength=self.size)
        self.waiting = []
        total = int(self.counts.sum())
        freq = 1 + (self.counts * (_SCALE - self.size) // total if total else np.zeros(self.size, np.int64))
        freq[int(freq.argmax())] += _SCALE - int(freq.sum())
        self.cum = np.concatenate((np.zeros(1, np.int64), np.cumsum(freq)))
        self.freq = freq
        self.inverse: np.ndarray | None = None
        self.w2 = np.minimum(62, 62 * self.hits2 // self.seen)
        self.w1 = np.minimum(62 - self.w2, 62 * self.hits1 // self.seen)

    def symbol(self, at: np.ndarray) -> np.ndarray:
        if self.inverse is None:
            self.inverse = np.repeat(np.arange(self.size), self.freq)
        return self.inverse[at]

    def look(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a = a
        self.slot = ((b * 40503 + a) * 2654435761 >> 13) & (_SLOTS - 1)
        self.g2, self.g1 = self.next2[self.slot].astype(np.int64), self.next1[a].astype(np.int64)
        self.q2, self.q1 = self.g2 >> 2, self.g1 >> 2
        self.context = (self.g2 & 3) * 8 + (self.g1 & 3) * 2 + (self.q1 == self.q2)
        self.m2, self.m1 = self.w2[self.context], self.w1[self.context]
        self.m0 = _PARTS - self.m2 - self.m1

    @staticmethod
    def _learned(g: np.ndarray, hit: np.ndarray, x4: np.ndarray) -> np.ndarray:
        """A hit adds to the confidence, a miss takes from it; an id without any gives way."""
        sure = g & 3
        return np.where(hit, g + (sure < 3), np.where(sure > 0, g - 1, x4))

    def update(self, x: np.ndarray) -> None:
        hit2, hit1 = self.q2 == x, self.q1 == x
        seen = np.bincount(self.context * 4 + hit2 * 2 + hit1, minlength=128).reshape(32, 4)
        self.seen += seen.sum(1)
        self.hits2 += seen[:, 2] + seen[:, 3]
        self.hits1 += seen[:, 1]
        x4 = x * 4
        self.next2[self.slot] = self._learned(self.g2, hit2, x4)
        self.next1[self.a] = self._learned(self.g1, hit1, x4)
        self.waiting.append(x)
        if len(self.waiting) == _REBUILD:
            self.rebuild()


def encode_block(ids: np.ndarray, size: int = VOCABULARY) -> bytes:
    n = len(ids)
    lanes = max(1, -(-n // STEPS))
    steps = min(STEPS, n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Mixture(size)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    out, at = np.zeros((lanes, 2 * steps + 8), np.uint16), np.zeros(lanes, np.int64)
    a, b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for x in grid:
        model.look(a, b)
        below = model.m0 * model.cum[x] + ((model.q1 < x) * model.m1 + (model.q2 < x) * model.m2) * _SCALE
        wide = model.m0 * model.freq[x] + ((model.q1 == x) * model.m1 + (model.q2 == x) * model.m2) * _SCALE
        unit = span >> _UBITS
        low += unit * below.astype(np.uint64)
        span = unit * wide.astype(np.uint64)
        while True:
            settled = (low ^ (low + span)) < _TOP
            narrow = ~settled & (span < _BOTTOM)
            i = np.nonzero(settled | narrow)[0]
            if not len(i):
                break
            j = np.nonzero(narrow)[0]
            span[j] = (~low[j] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
            out[i, at[i]] = (low[i] >> _U48).astype(np.uint16)
            at[i] += 1
            low[i] <<= _U16
            span[i] <<= _U16
        model.update(x)
        a, b = x, a
    every = np.arange(lanes)
    for _ in range(4):
        out[every, at] = (low >> _U48).astype(np.uint16)
        at += 1
        low <<= _U16
    words = out[np.arange(out.shape[1]) < at[:, None]]
    body = at.astype("<u2").tobytes() + words.astype("<u2").tobytes()
    return struct.pack("<IIII", n, lanes, len(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode_block(data: bytes | memoryview, offset: int = 0, size: int = VOCABULARY) -> tuple[np.ndarray, int]:
    """The ids of the block at ``offset`` and the offset behind it."""
    n, lanes, length, crc = struct.unpack_from("<IIII", data, offset)
    offset += 16
    counts = np.frombuffer(data, "<u2", lanes, offset).astype(np.int64)
    words = np.frombuffer(data, "<u2", (length - 2 * lanes) // 2, offset + 2 * lanes).astype(np.uint64)
    words = np.concatenate((words, np.zeros(4, np.uint64)))
    at = np.cumsum(counts) - counts
    steps = min(STEPS, n)
    model = Mixture(size)
    low, span, code = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << _U16) | words[np.minimum(at, len(words) - 1)]
        at += 1
    grid = np.zeros((steps, lanes), np.int64)
    a, b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    last = np.int64((1 << _BITS) - 1)
    for t in range(steps):
        model.look(a, b)
        q1, q2, m0, m1, m2, cum = model.q1, model.q2, model.m0, model.m1, model.m2, model.cum
        unit = span >> _UBITS
        v = np.minimum(((code - low) // unit).astype(np.int64), last)
        swap = q1 > q2
        p, q = np.minimum(q1, q2), np.maximum(q1, q2)
        same = p == q
        mp = np.where(swap, m2, m1)
        mq = (m1 + m2 - mp) * _SCALE
        mp = mp * _SCALE + same * mq
        mq *= ~same
        past_p = v >= m0 * cum[p + 1] + mp
        on_p = ~past_p & (v >= m0 * cum[p])
        v2 = v - past_p * mp
        past_q = past_p & (v2 >= m0 * cum[q + 1] + mq)
        on_q = past_p & ~past_q & (v2 >= m0 * cum[q])
        v3 = v2 - past_q * mq
        # exact: a quotient of integers this small is never rounded up to the next one
        x = model.symbol(np.minimum((v3 / m0).astype(np.int64), _SCALE - 1))
        x = np.where(on_p, p, np.where(on_q, q, x))
        below = m0 * cum[x] + ((q1 < x) * m1 + (q2 < x) * m2) * _SCALE
        wide = m0 * model.freq[x] + ((q1 == x) * m1 + (q2 == x) * m2) * _SCALE
        low += unit * below.astype(np.uint64)
        span = unit * wide.astype(np.uint64)
        while True:
            settled = (low ^ (low + span)) < _TOP
            narrow = ~settled & (span < _BOTTOM)
            i = np.nonzero(settled | narrow)[0]
            if not len(i):
                break
            j = np.nonzero(narrow)[0]
            span[j] = (~low[j] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
            code[i] = (code[i] << _U16) | words[np.minimum(at[i], len(words) - 1)]
            at[i] += 1
            low[i] <<= _U16
            span[i] <<= _U16
        grid[t] = x
        model.update(x)
        a, b = x, a
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of ids is damaged")
    return ids, offset + length


def write_file(doc_ids: list, lengths: list[int], ids: np.ndarray, size: int = VOCABULARY) -> bytes:
    index = zlib.compress(json.dumps([doc_ids, lengths], separators=(",", ":")).encode(), 3)
    blocks = [encode_block(ids[i : i + BLOCK_IDS], size) for i in range(0, len(ids), BLOCK_IDS)]
    header = json.dumps({"docs": len(doc_ids), "ids": len(ids), "blocks": len(blocks), "vocabulary": size, "index": len(index), "index_crc32": zlib.crc32(index)}).encode()
    return b"".join((MAGIC, struct.pack("<I", len(header)), header, index, *blocks))


def read_header(data: bytes) -> tuple[dict, int]:
    if data[:8] != MAGIC:
        raise ValueError("not a file of ids")
    n = struct.unpack_from("<I", data, 8)[0]
    return json.loads(data[12 : 12 + n]), 12 + n


def read_file(data: bytes) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids) of each document; one block of ids is held at a time, beside the open document."""
    header, at = read_header(data)
    index = data[at : at + header["index"]]
    if zlib.crc32(index) != header["index_crc32"]:
        raise ValueError("the index is damaged")
    at += header["index"]
    left = np.empty(0, np.uint32)
    for doc, n in zip(*json.loads(zlib.decompress(index)), strict=True):
        parts, have = [left], len(left)
        while have < n:
            block, at = decode_block(data, at, header["vocabulary"])
            parts.append(block)
            have += len(block)
        every = np.concatenate(parts) if len(parts) > 1 else left
        yield doc, every[:n]
        left = every[n:]


#: The name under which workers keep their words, while this module's scans run.
WORDS = "words"


class WordIds(dict):
    """Ids of the texts between blanks, as little-endian bytes; equal to encoding whole texts.

    The tokenizer drops white space before it merges, so no id spans a blank.  Plain Latin words go
    straight to the merge model, piece by piece; all others through the whole tokenizer.  Both
    memories are emptied when full, so they stay bounded.
    """

    LIMIT = 400_000
    PLAIN = re.compile(r"[\x21-\x7e\xa1-ſ]{1,100}")
    TAIL = ".,;:!?%$&#*"
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: ``PIECES`` for lowered plain words, with the letters and numbers of their range spelled out.
    LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼½¾]|[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        parts = json.loads(self.whole.to_str())
        kinds = [x["type"] for x in parts["normalizer"].get("normalizers", [])], [x["type"] for x in parts["pre_tokenizer"].get("pretokenizers", [])]
        patterns = [x["pattern"].get("Regex") for x in parts["pre_tokenizer"].get("pretokenizers", []) if "pattern" in x]
        self.direct = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and patterns == [self.PIECES.pattern]
        self.pieces: dict[str, bytes] = {}
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            if len(self.pieces) >= self.LIMIT:
                self.pieces.clear()
            shown = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            got = self.pieces[p] = struct.pack(f"<{len(t := self.model.tokenize(shown))}I", *[x.id for x in t])
        return got

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(self.TAIL)
        if self.direct and stem.isascii() and stem.isalpha() and len(word) <= 100:
            got = self.piece(stem.lower())
            if len(stem) < len(word):
                got += self.piece(word[len(stem) :])
        elif self.direct and self.PLAIN.fullmatch(word) and "<|" not in word:
            w = word.lower()
            got = self.piece(w) if w.isalpha() else b"".join(map(self.piece, self.LATIN.findall(w)))
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.LIMIT:
            self.clear()
            self[""] = b""
        self[word] = got
        return got

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def _words(path: str) -> WordIds:
    """One memory for each worker process, kept from task to task."""
    held = memory(WORDS, dict)
    if path not in held:
        held.clear()
        held[path] = WordIds(path)
    return held[path]


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Encode ``docs(doc_id, text)`` and write the files, named so that their order is that of doc_id.

    Documents are put in order by range; each task tokenises and writes its own range.  A file is
    written under a name of its own and then moved, so a task that runs again replaces it whole.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyspark import TaskContext

        end = struct.pack("<I", end_id)
        store, base = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        names: list[str] = []
        held: list = [[], [], [], 0]

        def flush() -> None:
            doc_ids, lengths, raw, _ = held
            if doc_ids:
                name = f"{base}/ids-{part:07d}-{len(names):05d}.idmix"
                data = write_file(doc_ids, lengths, np.frombuffer(b"".join(raw), "<u4"))
                own = f"{name}.{uuid4().hex}.tmp"
                with store.open_output_stream(own) as out:
                    out.write(data)
                store.move(own, name)
                names.append(name)
            held[:] = [[], [], [], 0]

        for batch in batches:
            words = _words(tokenizer)
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = words.ids(t.as_py()) + end
                held[0].append(d.as_py())
                held[1].append(len(ids) // 4)
                held[2].append(ids)
                held[3] += len(ids) // 4
                if held[3] >= file_ids:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    ordered.mapInArrow(frugal(scan, WORDS), "name string").count()


def read_ids(docs_schema_id: str, spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files in ``folder``."""
    store, base = pa.fs.FileSystem.from_uri(folder)
    if store.get_file_info(base).type != pa.fs.FileType.Directory or not store.get_file_info(pa.fs.FileSelector(base)):
        return spark.createDataFrame([], f"doc_id {docs_schema_id}, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idmix").load(folder).select("path", "content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_header(c.as_buffer().slice(0, min(4096, len(c.as_buffer()))).to_pybytes())[0]["ids"] for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], ["path", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                docs, starts, lengths, crcs, start = [], [], [], [], 0
                for doc, ids in read_file(content.as_buffer().to_pybytes()):
                    docs.append(doc)
                    starts.append(start)
                    lengths.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()] * len(docs), pa.string()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    ["path", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    # one row for each file, which holds millions of ids
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.mapInArrow(frugal(heads, WORDS), "path string, ids long").select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    rows = files.mapInArrow(frugal(scan, WORDS), "path string, doc_id long, at long, n_tokens long, ids_crc32 long")
    joined = rows.join(offsets, "path")
    return joined.select(F.col("doc_id").cast(docs_schema_id).alias("doc_id"), (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of all documents to files in the shared folder and report what the files hold."""
    folder = scratch(docs.sparkSession, "ids")
    write_ids(docs, tokenizer, folder)
    return read_ids(docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession, folder)
