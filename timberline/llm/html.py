"""Main-text extraction with markup and a host suffix array.

Each page is parsed, once, into blocks of text, each with the kind of the container it stands in:
``main`` (article, main), ``aside`` (menus, headers, footers, side bars, notices, adverts, forms,
comments) or ``open``.  Within a host the token streams of all blocks outside an article are
concatenated page by page and a suffix array over them finds the runs of ``RUN`` tokens that occur on
distinct pages.  The arrays are built in each task, one for each host and chunk of ``CHUNK``
pages, and yield one row for each run with the least and greatest page that has it; the rows of a run,
from whatever chunk, meet in an aggregate, so no text is shuffled for them, a host is never gathered
in one task and a run is found wherever its pages lie.  A page is its blocks outside the article:
copies of a page, under one page_id or several, are one page, so a copy makes nothing boilerplate.

What decides.  ``open`` blocks of a page without an article stay if they are unique: repeated runs
cover less than ``COVERED`` of their tokens.  Elsewhere markup decides, since there the array alone is
wrong both ways: articles share long passages and keep them, and menus, adverts and comments may be
unlike on every page.  So ``aside`` blocks go, an article's blocks stay whole, and beside an article
``open`` blocks go.

Text: character references decoded, white space within a block made one space, trimmed, blocks
joined by two line breaks.

Defined results: a null or empty html has an empty text; a null url counts as an empty host; rows
that repeat a page_id, or have none, are pages of their own and all kept; broken or unclosed markup
closes with its container; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, settle

RUN = 6
COVERED = 0.5
#: Pages that a task looks at together: those of one host among them make one suffix array.
CHUNK = 2048

_TAG = regex.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", regex.S)
_ATTR = regex.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAMING = {"class", "id", "role"}
_SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title", "head", "select", "math"}
_ASIDE = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button"}
_MAIN = {"article", "main"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NOISE = regex.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|footer|header|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[\s_-])", regex.I)
_RAW_END = {t: regex.compile(rf"</{t}\s*>", regex.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
#: What an article is called that is not the page's: a reader's comment, a teaser, an advert.
_OTHER_ARTICLE = regex.compile(r"(?:^|\s)(?:comments?(?:$|[\s_-])|(?:ads?|advert|promo|related|reply|sponsored|teaser|widget)(?:$|\s))", regex.I)


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of each block of a page, in order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # tag, kind of its content
    buf: list[str] = []
    kind = "open"

    def close() -> None:
        if buf:
            t = " ".join(unescape("".join(buf)).split())
            buf.clear()
            if t and kind != "skip":
                out.append((kind, t))

    at, html = 0, html or ""
    n = len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            buf.append(html[at:])
            break
        if lt > at:
            buf.append(html[at:lt])
        m = _TAG.match(html, lt)
        if not m:
            buf.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1] is not None:
            buf.append(m[1].replace("&", "&amp;"))
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:  # an end tag
            if tag in _INLINE:
                continue
            close()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
                kind = stack[-1][1] if stack else "open"
            continue
        if tag in _INLINE:
            continue
        if tag == "br":
            buf.append(" ")
            continue
        close()
        if tag in _VOID:
            continue
        if tag in _RAW_END:
            e = _RAW_END[tag].search(html, at)
            at = e.end() if e else n
            continue
        if tag == "p" or tag == "li":
            if stack and stack[-1][0] == tag:
                stack.pop()
        own = kind = stack[-1][1] if stack else "open"
        if own not in ("skip", "aside"):
            said = " ".join("".join(a[1:]) for a in _ATTR.findall(m[4] or "") if a[0].lower() in _NAMING)
            if tag in _SKIP:
                own = "skip"
            elif tag in _MAIN or said == "main":
                own = "aside" if _OTHER_ARTICLE.search(said) else "main"
            elif tag in _ASIDE and not (tag == "header" and own == "main"):
                own = "aside"
            elif said and tag not in ("body", "html") and _NOISE.search(said):
                own = "aside"
        if not (m[4] or "").rstrip().endswith("/"):
            stack.append((tag, own))
            kind = own
    close()
    return out


def long_runs(pages: list[tuple[object, list[str]]], run: int = RUN) -> list[tuple[int, object, object]]:
    """(hash, first page, last page) of each run of ``run`` tokens, once, from a suffix array over all streams.

    ``pages`` are (page, tokens) streams; no run crosses a stream.
    """
    ids: dict[str, int] = {}
    stream: list[int] = []
    owner: list[int] = []
    for k, (_, tokens) in enumerate(pages):
        stream.extend(ids.setdefault(t, len(ids) + 1) for t in tokens)
        stream.append(0)
        owner.extend([k] * (len(tokens) + 1))
    s = np.array(stream, np.int64)
    n = len(s)
    if n <= run:
        return []
    # prefix doubling: after each round suffixes are ranked by twice as many tokens, up to the run
    rank, k = s, 1
    while k < run:
        step = min(k, run - k)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:]
        order = np.lexsort((later, rank))
        change = np.concatenate(([0], (np.diff(rank[order]) != 0) | (np.diff(later[order]) != 0)))
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(change)
        rank, k = new, k + step
    ends = np.cumsum(s == 0)
    whole = np.zeros(n, bool)
    whole[: n - run + 1] = ends[run - 1 :] - ends[: n - run + 1] + (s[: n - run + 1] == 0) == 0
    at = np.nonzero(whole)[0]
    if not len(at):
        return []
    at = at[np.argsort(rank[at], kind="stable")]  # suffix order; within a run by place
    first = np.concatenate(([True], rank[at][1:] != rank[at][:-1]))
    starts = np.nonzero(first)[0]
    lasts = np.concatenate((starts[1:], [len(at)])) - 1
    word = [None, *ids]
    out = []
    for a, z in zip(at[starts], at[lasts], strict=True):
        tokens = " ".join(word[i] for i in stream[a : a + run])
        out.append((xxhash.xxh3_64_intdigest(tokens) - (1 << 63), pages[owner[a]][0], pages[owner[z]][0]))
    return out


def _tokens(text: str, run: int) -> list[str]:
    t = text.split()
    return t + ["\x02"] * max(0, run - len(t))  # a short block is one run with its end marks


def parse(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, z, loose, ask`` of each page: its blocks compressed, a hash of those outside the article, whether open blocks are to be decided."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            zs, loose, ask = [], [], []
            for h in batch.column(2):
                got = blocks(h.as_py())
                zs.append(squeeze(json.dumps(got, ensure_ascii=False).encode("utf-8", "surrogatepass")))
                kinds = {k for k, _ in got}
                ask.append("open" in kinds and "main" not in kinds)
                loose.append(xxhash.xxh3_64_intdigest("\x02".join(t for k, t in got if k != "main").encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(zs, pa.binary()), pa.array(loose, pa.int64()), pa.array(ask, pa.bool_())], ["page_id", "url", "z", "loose", "ask"])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    x = pages.select("page_id", "url", "html").mapInArrow(frugal(scan), f"page_id {kind}, url string, z binary, loose long, ask boolean")
    return x.withColumn("host", host)


def host_runs(parsed: DataFrame, run: int = RUN, chunk: int = CHUNK) -> DataFrame:
    """``host, h`` of each run that occurs on distinct pages of a host, outside articles."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in (b.slice(at, chunk) for b in batches for at in range(0, b.num_rows, chunk)):
            by_host: dict[str, list] = {}
            for host, page, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                by_host.setdefault(host, []).extend((page, _tokens(t, run)) for k, t in json.loads(open_(z.as_py())) if k != "main")
            rows = [(host, h, min(p, q), max(p, q)) for host, streams in by_host.items() for h, p, q in long_runs(sorted(streams, key=lambda x: x[0]), run)]
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), *[pa.int64()] * 3), strict=True)], ["host", "h", "lo", "hi"])

    runs = parsed.select("host", "loose", "z").mapInArrow(frugal(arrays), "host string, h long, lo long, hi long")
    return runs.groupBy("host", "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("host", "h")


def covered_blocks(parsed: DataFrame, repeated: DataFrame, run: int = RUN, covered: float = COVERED) -> DataFrame:
    """``row, gone``: the open blocks, by number, of the pages ``row, host, z`` that runs of ``repeated`` cover for the most part."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            rows: list[tuple] = []
            for key, host, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for i, (k, text) in enumerate(json.loads(open_(z.as_py()))):
                    if k == "open":
                        t = _tokens(text, run)
                        rows.extend((host, xxhash.xxh3_64_intdigest(" ".join(t[j : j + run])) - (1 << 63), key, i, j, len(t)) for j in range(len(t) - run + 1))
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["host", "h", "row", "i", "j", "n"])

    at = parsed.select("row", "host", "z").mapInArrow(frugal(mark), "host string, h long, row long, i int, j int, n int")
    # tokens of a block inside repeated runs: the length of the union of [j, j + run)
    hits = at.join(repeated, ["host", "h"]).groupBy("row", "i").agg(F.array_sort(F.collect_set("j")).alias("js"), F.max("n").alias("n"))
    union = F.aggregate("js", F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), lambda acc, j: F.struct((j + run).alias("end"), (acc["sum"] + (j + run) - F.greatest(acc["end"], j)).alias("sum")), lambda acc: acc["sum"])
    return hits.where(union >= F.col("n") * covered).groupBy("row").agg(F.collect_set("i").alias("gone"))


def extract(pages: DataFrame, run: int = RUN, covered: float = COVERED, chunk: int = CHUNK) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``."""
    kind = pages.schema["page_id"].dataType.simpleString()
    # the row numbers are written with the blocks, so they hold however often a task runs again
    parsed = settle(parse(pages).withColumn("row", F.monotonically_increasing_id()), "blocks")
    asked = parsed.where("ask")
    # a table of its own, so that a host's common run is a side of a join that can be split
    gone = covered_blocks(asked, settle(host_runs(parsed, run, chunk), "runs"), run, covered)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            texts = []
            for z, lost in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                every, lost = json.loads(open_(z.as_py())), set(lost or ())
                has_main = any(k == "main" for k, _ in every)
                texts.append("\n\n".join(t for i, (k, t) in enumerate(every) if k == "main" or (k == "open" and not has_main and i not in lost)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    told = asked.join(gone, "row", "left").select("page_id", "url", "z", "gone")
    clear = parsed.where("not ask").select("page_id", "url", "z", F.lit(None).cast("array<int>").alias("gone"))
    kept = told.union(clear).mapInArrow(frugal(keep), f"page_id {kind}, url string, text string")
    return kept.withColumn("n_chars", F.length("text").cast("long"))
