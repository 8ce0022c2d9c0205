"""Scalar functions, miners, commands and files against plain Python."""

import io
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from timberline import cli
from timberline.functions import text as X
from timberline.operators import mining
from timberline.plans import search as S
from timberline.plans.query import Common, QueryError, Token
from timberline.sources import corpus, store
from timberline.streaming import tail

EVENTS = "/root/testdata/sf0.001"


def column(spark, values, f):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_scalars(spark):
    tokens = [" ", "\t", ":", "=", ",", "a", "<V0>", "<V12>", "<V>", "", "ab", None]
    assert column(spark, tokens, X.is_delimiter) == [True] * 5 + [False] * 6 + [None]
    assert column(spark, tokens[:11], X.segment_kind) == ["delimiter"] * 5 + ["constant", "variable", "variable", "constant", "constant", "constant"]
    assert column(spark, ["(1,2,3)", "4", "(5, x ,6)", "()"], X.int_list) == [[1, 2, 3], [4], [5, None, 6], [None]]
    assert column(spark, [" a b\t", "\r\n", "x"], X.trimmed) == ["a b", "", "x"]
    assert column(spark, ["12", "-3", "1x", "", "99999999999", None], lambda v: X.number(v, "int")) == [12, -3, None, None, None, None]
    assert column(spark, ["1.5", ".5", "2e3", "x", "-7"], lambda v: X.number(v, "double")) == [1.5, 0.5, 2000.0, None, -7.0]
    assert column(spark, ["abcdef", "ab"], lambda v: X.piece(v, 1, 3)) == ["bcd", "b"]
    assert column(spark, ["a1 B-é", "", "0F"], X.shape_masks) == ["<V,5><-1><V,2>-é", "", "<V,3>"]

    def plain_hash(v):
        h = 0
        for b in v.encode():
            h = (h * 131 + b) & 0x7FFFFFFF
        return h

    texts = ["", "a", "Error at 0x1F", "é日本", "long" * 50]
    assert column(spark, texts, X.hash31) == [plain_hash(t) for t in texts]


def test_split_patterns_are_plain(spark):
    rng = random.Random(1)
    columns = {(0, 0): [f"blk_{rng.randint(10, 99)}" for _ in range(1500)], (0, 1): [rng.choice(["a-1", "b-22", "x"]) for _ in range(300)], (3, 0): ["same"] * 40, (3, 1): [f"/{rng.randint(1, 9)}.{rng.randint(100, 999)}/end" for _ in range(200)] + ["odd one"] * 3}
    vals = [(e, v, i, x) for (e, v), xs in columns.items() for i, x in enumerate(xs)]
    vals = spark.createDataFrame(vals, "eid int, var_idx int, line_no long, value string")
    got = {(r["eid"], r["var_idx"]): r["pattern"] for r in mining.split_patterns(vals).collect()}
    md5 = lambda i: __import__("hashlib").md5(str(i).encode()).hexdigest()
    want = {k: mining.split_pattern([xs[i] for i in sorted(range(len(xs)), key=md5)[: max(1000, int(len(xs) * 0.0001))]]) for k, xs in columns.items()}
    assert got == want and got[0, 0].startswith("blk_<F") and got[3, 0] == "same"
    split = mining.split_values(vals, mining.split_patterns(vals))
    for r in split.collect():
        value = columns[r["eid"], r["var_idx"]][r["line_no"]]
        m = re.fullmatch(mining.pattern_regex(got[r["eid"], r["var_idx"]]), value)
        assert (r["value"] == value and r["pieces"] is None) or (m and r["pieces"] == list(m.groups()) and r["value"] is None)
    assert split.where("value = 'odd one'").count() == 3
    again = {(r["eid"], r["var_idx"], r["line_no"]): r["value"] for r in mining.joined_values(split, mining.split_patterns(vals)).collect()}
    assert again == {(e, v, i): x for (e, v), xs in columns.items() for i, x in enumerate(xs)}


def test_greedy_is_plain(spark):
    rng = random.Random(2)
    lines = [(b, i, " ".join(rng.choice(("get", "put", "x1", "x2")) for _ in range(rng.choice((2, 3))))) for b in (1, 2) for i in range(80)]
    got = Counter((r["block_id"], r["n_rows"], tuple(r["slots"])) for r in mining.greedy_mine(spark.createDataFrame(lines, "block_id long, line_no long, line string")).collect())
    pool = defaultdict(list)
    for b, _, line in lines:
        w = line.split()
        for t in pool[b, len(w)]:
            if sum(y is None or x == y for x, y in zip(w, t[0])) / len(w) > 0.5:
                t[0] = [x if x == y else None for x, y in zip(w, t[0])]
                t[1] += 1
                break
        else:
            pool[b, len(w)].append([w, 1])
    assert got == Counter((b, n, tuple("<*>" if x is None else x for x in t)) for (b, _), ts in pool.items() for t, n in ts)


def test_likeness(spark):
    a, b = ["a", " ", "b", ":", "c"], ["a", " ", "x", ":", "c"]
    df = spark.createDataFrame([(a, b), (a, ["a", "=", "b", ":", "c"]), (a, a[:3]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(mining.likeness(F.col("a"), F.col("b"))).collect()] == [0.8, 0.0, 0.0, 0.0]


def test_ends_of_columns(spark):
    """A word is looked for on prefix, suffix and between: never missed, and dropped where it cannot lie."""
    rng = random.Random(3)
    values = [f"pre-{rng.choice('0123456789abc') * rng.randint(1, 3)}.log" for _ in range(150)]
    lines = spark.createDataFrame([(1, i, f"open {v} now") for i, v in enumerate(values)], "block_id long, line_no long, line string")
    vals = mining.values(mining.match(lines, mining.number(mining.mine(lines))))
    meta = mining.column_meta(vals).first()
    assert (meta["prefix"], meta["suffix"]) == ("pre-", ".log")
    column = F.struct(*[F.col(c) for c in ("char_mask", "max_len", "prefix", "suffix")])
    may = lambda w: mining.column_meta(vals).select(S.may_hold(column, w)).first()[0]
    for v in rng.sample(values, 12):
        i, j = sorted(rng.sample(range(len(v) + 1), 2))
        assert may(v[i:j])
    assert not may("pre-0000") and not may("re-1234.lo") and not may("Z")


def test_tokens_and_common_parts(spark):
    lines = spark.createDataFrame([("a=77,b",), ("a=770",), ("77",), ("xabcdy",)], "line string")
    hit = lambda c: [r["line"] for r in lines.where(c.column(F.col("line"))).collect()]
    assert hit(Token("77")) == ["a=77,b", "77"] and hit(Common("zabcdz", 4)) == ["xabcdy"] and hit(Common("ab", 3)) == []
    with pytest.raises(QueryError):
        hit(Token("a=7"))


def test_number_of_lines_in_texts(spark):
    """Texts of very many lines, and equal lines that arrive, keep numbers of their own."""
    docs = spark.createDataFrame([(1, "\n".join("ab" * 60_000)), (2, "x\ny")], "doc_id long, text string")
    x = corpus._pieces(docs, F.col("doc_id"), "text")
    assert x.count() == x.select("line_no").distinct().count() == 120_002


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    rng = random.Random(4)
    lines = [f"{rng.choice(('GET', 'PUT'))} user={i % 7} took {rng.randint(1, 999)} ms" for i in range(300)] + ["lonely line é"]
    (folder / "1.log").write_text("\n".join(lines[:200]) + "\n")
    (folder / "2.log").write_text("\n".join(lines[200:]))
    (folder / ".hidden").write_text("GET hidden\n")
    return folder, lines


def test_files(spark, logs, tmp_path):
    folder, lines = logs
    read = lambda **kw: corpus.read_text(spark, str(folder), **kw)
    assert sorted(r["line"] for r in read().collect()) == sorted(lines)
    assert corpus.read_text(spark, corpus.numbered(str(folder), 1, 2)).count() == 301 and read(min_bytes=10**6).count() == 0
    store.dump(read().where("line like 'PUT%'"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == sum(x.startswith("PUT") for x in lines)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.log").write_text("good\n")
    (tmp_path / "bad" / "b.log.gz").write_bytes(b"\x1f\x8b\x08 this is no archive")
    assert [r["line"] for r in corpus.read_text(spark, str(tmp_path / "bad"), skip_bad=True).collect()] == ["good"]


def test_stores_of_a_folder(spark, logs, tmp_path):
    folder, lines = logs
    for n in (1, 2):
        store.write(corpus.read_text(spark, f"{folder}/{n}.log"), str(tmp_path / f"s{n}"))
    (tmp_path / "s3").mkdir()
    (tmp_path / ".s4").mkdir()
    held = store.open_all(spark, str(tmp_path))
    assert len(held) == 2
    found = S.search_all(held, "user=3 and PUT")
    assert found.total() == sum("user=3" in x and "PUT" in x for x in lines)
    one = S.search(held[0], "user=3")
    n = one.statistics(held[0])
    assert n["rows"] == 200 and n["rows_matched"] == sum("user=3" in x for x in lines[:200]) <= n["rows_read"]
    assert S.search(held[0], "POST").statistics(held[0])["templates_left"] == 0 and {"parse", "prune"} <= set(one.seconds)
    assert held[0].raw_bytes() == sum(len(x.encode()) + 1 for x in lines[:200]) and held[0].stored_bytes() > 0


def test_commands(spark, logs, tmp_path, capsys, monkeypatch):
    folder, lines = logs
    at = str(tmp_path / "s")
    say = lambda *args: (cli.run(spark, list(args)), capsys.readouterr().out)
    assert "ratio" in say("ingest", at, str(folder))[1]
    assert f"{sum('user=3' in x and 'GET' in x for x in lines)} lines" in say("search", at, "user=3 and GET")[1]
    assert f"{sum(bool(re.search('took 1[0-9] ms', x)) for x in lines)} lines" in say("search", at, "took 1[0-9] ms", "-reg")[1]
    assert f"{sum('77' in re.split('[ =]', x) for x in lines)} lines" in say("search", at, "77", "-t")[1]
    assert "1 lines" in say("grep", str(folder), "é", "-m")[1]
    assert say("patlist", at)[1].splitlines()[0].startswith("0\t")
    assert "<V0>" in say("patbody", at, "0")[1] and len(say("varlist", at, "0")[1].splitlines()) >= 2
    assert all("3" in x.split("\t")[1] for x in say("vals", at, "0", "1", "-reg", "3")[1].splitlines())
    assert say("nothing")[0] == 2 and say("search", at)[0] == 2
    monkeypatch.setattr("sys.stdin", io.StringIO(f"con {at}\nsearch 'user=3 and GET'\nsearch 'and GET'\ndiscon\nexit\npatlist\n"))
    cli.shell(spark)
    out = capsys.readouterr().out
    assert "lines" in out and "operand" in out


def test_equal_lines_that_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("same line 1\nsame line 1\nsame line 2\n")
    folder = str(tmp_path / "store")
    store.write(spark.createDataFrame([(1, i, f"same line {i}") for i in range(5)], "block_id long, line_no long, line string"), folder)
    tail.into_store(tail.lines(spark, str(tmp_path / "in")), folder, str(tmp_path / "state")).awaitTermination(120)
    held = store.Store(spark, folder)
    assert held.stored.count() == 8 == held.rows.select("block_id", "line_no").distinct().count()


def test_wide_templates(spark, tmp_path):
    """More variables than the store has columns for."""
    lines = [(1, i, " ".join(f"w{i * j}" for j in range(1, 30))) for i in range(40)]
    folder = str(tmp_path / "wide")
    store.write(spark.createDataFrame(lines, "block_id long, line_no long, line string"), folder)
    held = store.Store(spark, folder)
    assert sorted(tuple(r) for r in held.lines().collect()) == lines
    assert [r["value"] for r in held.values(0, 25).orderBy("line_no").collect()] == [f"w{i * 26}" for i in range(40)]
