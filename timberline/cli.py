"""Commands on stores of log lines.

    ingest STORE TEXT...                 store the lines of text files; prints bytes, ratio and MB a second
    search STORE QUERY [-m | -reg | -t]  lines that match (logic, one phrase, a regular expression, a token)
    grep TEXT QUERY [-m | -reg | -t]     the same over text files
    patlist STORE | patbody STORE E | varlist STORE E | vals STORE E V [-reg TEXT]
    shell                                con STORE, discon, exit, and the commands above without STORE
"""

from __future__ import annotations

import shlex
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog
from .plans.query import QueryError
from .plans.search import LIMIT, scan, search
from .sources import corpus, store

#: Rows shown at a time.
PAGE = 30
KINDS = {"-l": "l", "-m": "m", "-reg": "reg", "-t": "t"}


def _kind(args: list[str]) -> str:
    return KINDS.get(args[0], "l") if args else "l"


def _print(rows: DataFrame) -> None:
    for n, row in enumerate(rows.toLocalIterator()):
        if n and n % PAGE == 0 and sys.stdin.isatty() and input("more? [y/n] ").strip().lower() == "n":
            return
        print(*row, sep="\t")


def ingest(spark: SparkSession, folder: str, texts: list[str]) -> None:
    began = time.time()
    steps = store.write(corpus.read_text(spark, texts, skip_bad=True), folder)
    took, held = time.time() - began, store.Store(spark, folder)
    raw, stored = held.raw_bytes(), held.stored_bytes()
    print(f"{raw} bytes as {stored}, ratio {raw / max(1, stored):.1f}, {raw / 1e6 / took:.1f} MB/s, " + ", ".join(f"{k} {v:.2f} s" for k, v in steps.items()))


def run(spark: SparkSession, args: list[str]) -> int:
    """One command; 0 if it was one."""
    name, *rest = args
    if name == "ingest" and len(rest) >= 2:
        ingest(spark, rest[0], rest[1:])
    elif name == "search" and len(rest) >= 2:
        found = search(store.Store(spark, rest[0]), rest[1], kind=_kind(rest[2:]))
        _print(found.rows().select("line"))
        print(f"{found.total()} lines; " + ", ".join(f"{k} {v:.2f} s" for k, v in found.seconds.items()))
    elif name == "grep" and len(rest) >= 2:
        lines = scan(corpus.read_text(spark, rest[0]), rest[1], _kind(rest[2:]))
        _print(lines.select("line").limit(LIMIT))
        print(f"{lines.count()} lines")
    elif name in ("patlist", "templates") and len(rest) == 1:
        _print(catalog.template_list(store.Store(spark, rest[0])))
    elif name == "patbody" and len(rest) == 2:
        _print(catalog.template_body(store.Store(spark, rest[0]), int(rest[1])))
    elif name == "varlist" and len(rest) == 2:
        _print(catalog.column_list(store.Store(spark, rest[0]), int(rest[1])))
    elif name == "vals" and len(rest) >= 3:
        _print(catalog.column_values(store.Store(spark, rest[0]), int(rest[1]), int(rest[2]), rest[4] if rest[3:4] == ["-reg"] else None).limit(LIMIT))
    else:
        print(__doc__)
        return 2
    return 0


def shell(spark: SparkSession) -> None:
    """Commands line by line; after ``con STORE`` the others need no store."""
    at = None
    for text in sys.stdin:
        words = shlex.split(text)
        if not words:
            continue
        if words[0] == "exit":
            return
        if words[0] == "con" and len(words) == 2:
            at = words[1]
        elif words[0] == "discon":
            at = None
        else:
            try:
                run(spark, [words[0], at, *words[1:]] if at and words[0] not in ("grep", "ingest") else words)
            except QueryError as e:
                print(e)


def main(args: list[str]) -> int:
    if not args or args[0] in ("-h", "--help"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("timberline").getOrCreate()
    if args == ["shell"]:
        shell(spark)
        return 0
    try:
        return run(spark, args)
    except QueryError as e:
        print(e)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
