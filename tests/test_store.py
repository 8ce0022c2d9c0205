import random

import pytest
from pyspark.sql import functions as F

from timberline.functions.text import longest_common_substring
from timberline.operators import mining
from timberline.plans import catalog
from timberline.plans.query import parse
from timberline.plans.search import Session, scan, search, surviving
from timberline.sources import store
from timberline.sources.corpus import CORPORA
from timberline.streaming import tail

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    lines = CORPORA["events"](spark, SMALL).union(CORPORA["orders"](spark, SMALL)).union(CORPORA["conversations"](spark, SMALL).limit(300)).persist()
    folder = str(tmp_path_factory.mktemp("store"))
    store.write(lines, folder)
    return lines, store.Store(spark, folder)


def keys(df):
    return sorted((r["block_id"], r["line_no"], r["line"]) for r in df.select("block_id", "line_no", "line").collect())


@pytest.mark.parametrize("small", [True, False])
def test_pruned_search_is_plain_search(made, spark, monkeypatch, small):
    lines, held = made
    if not small:  # what a store beyond the bounds is asked by
        monkeypatch.setattr(store, "SMALL_ROWS", 0)
        held = store.Store(spark, held.folder)
    assert (held.small is not None) == small
    rng = random.Random(1)
    texts = [r["line"] for r in lines.orderBy("line_no").collect()]
    asked = ["user=8", "ERROR or CLICK and user=1 not value=1", "status:F", "prio=1*T", "not user", "é"]
    for _ in range(4):
        line = rng.choice([t for t in texts if len(t) > 12])
        at = rng.randrange(len(line) - 8)
        asked.append(line[at : at + 8])
    for text in asked:
        try:
            want = keys(scan(lines, text))
        except ValueError:
            continue
        got = search(held, text)
        assert keys(got.rows(None)) == want and got.total() == len(want), text
        assert len(got.rows(5).collect()) == min(5, len(want))


def test_small_and_large_stores_prune_alike(made, spark, monkeypatch):
    held = made[1]
    asked = ["user=8", "ERROR or CLICK and user=1 not value=1", "status:F", "prio=1*T", "not user", "NOSUCHTOKEN#", "value=1 or order=7", "x" * 30]
    near = [surviving(held, parse(text)) for text in asked]
    assert held.small is not None
    monkeypatch.setattr(store, "SMALL_BYTES", 0)
    other = store.Store(spark, held.folder)
    assert other.small is None
    assert [surviving(other, parse(text)) for text in asked] == near
    other.close()


def test_pruning_drops_templates(made):
    held = made[1]
    assert search(held, "NOSUCHTOKEN#").eids == [-1] or len(search(held, "NOSUCHTOKEN#").eids) < held.templates.count()


def test_lines_come_back(made, spark):
    lines, held = made
    x = mining.rebuild(held.rows.drop("bucket"), held.templates)
    assert x.where("rebuilt <> line").count() == 0 and x.count() == lines.count()


def test_session(made):
    lines, held = made
    s = Session(held, keep=2)
    for text in ("ERROR", "ERROR and user=8", "ERROR and user=8 and value=1", "CLICK"):
        assert keys(s.search(text).rows(None)) == keys(scan(lines, text))
    assert len(s.held) == 2
    s.close()


def test_catalog(made):
    held = made[1]
    top = catalog.template_list(held).first()["eid"]
    assert "<V0>" in catalog.template_body(held, top).first()["template"]
    assert catalog.column_list(held, top).count() > 0
    every = catalog.column_values(held, top, 0)
    some = catalog.column_values(held, top, 0, "1")
    assert some.count() == every.where(F.col("value").contains("1")).count() > 0


def test_miners():
    assert longest_common_substring("xabcdy", "zabcd") == "abcd"
    assert mining.split_pattern([f"blk_{i}" for i in range(10, 90)]) == "blk_<F,1,2>"
    assert mining.similarity(["a", "b"], ["a", None]) == 1


def test_greedy_miner(spark):
    df = spark.createDataFrame([(1, i, f"user {i} in") for i in range(5)] + [(1, 9, "x=1")], "block_id long, line_no long, line string")
    got = {(r["n_rows"], tuple(r["slots"])) for r in mining.greedy_mine(df).collect()}
    assert got == {(5, ("user", "<*>", "in")), (1, ("x", "1"))}


def test_stream(made, spark, tmp_path):
    held = made[1]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("new line one\nanother\n")
    before = held.rows.count()
    q = tail.into_store(tail.matching(tail.lines(spark, str(tmp_path / "in")), "new"), held.folder, str(tmp_path / "state"))
    q.awaitTermination(120)
    spark.catalog.refreshByPath(f"{held.folder}/rows")
    assert spark.read.parquet(f"{held.folder}/rows").count() == before + 1


def test_search_after_append(spark, tmp_path):
    folder = str(tmp_path / "store")
    line = lambda no, user: (1, no, f"user={user} logged in")
    kind = "block_id long, line_no long, line string"
    store.write(spark.createDataFrame([line(i, i) for i in range(9)], kind), folder)
    store.append(spark.createDataFrame([line(10, "Longer_name"), line(11, 5)], kind), folder)
    held = store.Store(spark, folder)
    for text in ("Longer_name", "nger", "user=5"):
        assert keys(search(held, text).rows(None)) == keys(scan(held.lines(), text)) != [], text
    want = mining.column_meta(mining.values(held.rows))
    assert sorted(held.columns.collect()) == sorted(want.select(*held.columns.columns).collect())
    assert held.columns.count() == 1 and held.bounds.count() == 2
