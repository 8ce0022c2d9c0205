import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from timberline.llm import langid, mixing
from timberline.llm.common import settle

from . import plain

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = settle(stage(spark, docs, SMALL), name.split()[0])
        out.append((before, docs))
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_stages_keep_the_columns(steps):
    assert len(steps) == 5 and all(after.columns == before.columns for before, after in steps[:-1])


def test_language_stage(steps):
    before, after = steps[0]
    model = langid.Classifier(langid.fit(before))
    want = {r["doc_id"] for r in before.collect() if model.predict(r["text"])[2] >= langid.MARGIN}
    assert set(ids(after)) == want and len(want) >= 0.9 * before.count()


def test_near_duplicate_stage(steps):
    before, after = steps[1]
    groups = plain.components([(r["doc_id"], r["text"]) for r in before.collect()], width=5, num=80)
    assert sorted(ids(after)) == sorted(d for d, (_, c) in groups.items() if c == d)


def test_decontamination_stage(spark, steps):
    before, after = steps[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in before.collect() if any(" ".join(t.split()[:10]) in " ".join(r["text"].split()) for _, t in items)}
    assert bad.isdisjoint(ids(after)) and set(ids(after)) <= set(ids(before))


def test_null_and_repeated_ids(spark):
    word = random.Random(6).choices([f"w{i}" for i in range(5000)], k=400)
    text = lambda i: " ".join(word[40 * i : 40 * i + 40])
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [
        (None, text(0), "a"), (None, text(1), "a"), (None, text(1), "a"), (None, text(2), "a"), (7, text(2), "b"), (3, text(3), "a"), (3, text(3), "a"),
        (3, text(3), "b"), (4, text(4), "a"), (4, text(5), "a"), (None, None, "a"), (None, None, "a"), (5, "", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()), key=str)
    want = [(None, text(0)), (None, text(1)), (7, text(2)), (3, text(3)), (4, text(4)), (4, text(5)), (None, None), (None, None), (5, "")]
    assert got == sorted(want, key=str)
    bad = spark.createDataFrame([(None, leak, "a"), (4, f"so {leak}", "a")], docs.schema)
    clean = corpus_pipeline.decontaminate(spark, docs.union(bad), SMALL)
    assert sorted(clean.collect(), key=str) == sorted(docs.collect(), key=str)


CLASHES = {"score": 7.5, "margin": 1.5, "accepted": False, "lang_pred": "x", "row_key": 1, "n": 2, "n_shingles": 3, "place": 4, "reps": 5, "size": 6, "key": 7, "z": 8, "text2": None, "doc.id": 9}


def test_edge_rows_pass_every_stage(spark):
    """Null and repeated ids, null and empty texts, equal rows, clashing columns: each stage keeps the columns and their values."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    more = [(None, None, None, None, 0), (None, "", "xx", None, 0), (3, "The words of a text that is like no other text here at all.", None, "s", 9)]
    more = spark.createDataFrame([*more, more[2], more[1]], docs.schema)
    docs = docs.unionByName(more).withColumns({f"{k}": F.lit(v) for k, v in CLASHES.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, docs, SMALL), name.split()[0])
        assert out.columns == docs.columns, name
        got = out.select(*[f"`{c}`" for c in CLASHES]).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(CLASHES.values())], name
        assert stage(spark, docs.where("false"), SMALL).count() == 0
    n = corpus_pipeline.token_ids(spark, docs, SMALL).count()
    assert n == docs.count() and corpus_pipeline.token_ids(spark, docs.where("false"), SMALL).count() == 0


def test_mix_by_row(spark):
    """Rows of one id, or none, are taken each by their own share."""
    rows = [(i % 3 if i % 2 else None, f"{'word ' * (1 + i % 7)}", "abc"[i % 3 % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    want = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert sizes(corpus_pipeline.mix(spark, docs, SMALL)) == want


def test_mixing_stage(steps):
    before, after = steps[3]
    reps = {r["doc_id"]: r["reps"] for r in mixing.mix(before).collect()}
    got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in reps.items() if n}


def test_token_stage(steps):
    before, after = steps[4]
    assert sorted(ids(before)) == sorted(ids(after))
    row = after.agg(F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("sum")).first()
    assert row["end"] == row["sum"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
