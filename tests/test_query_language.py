import pytest
from pyspark.sql import functions as F

from timberline.plans.query import And, Not, Or, Phrase, QueryError, parse
from timberline.plans.search import scan

P = Phrase


@pytest.mark.parametrize(
    "text, tree",
    [
        ("A", P("A")), ("and", P("and")), ("a b:c", P("a b:c")), ("a  b", P("a  b")),
        ("A or B and C not D", And((Or((P("A"), P("B"))), And((P("C"), Not(P("D"))))))),
        ("A AND B", And((P("A"), P("B")))), ("A:and=B", And((P("A"), P("B")))), ("A  and B", And((P("A "), P("B")))),
        ("A not B or C", And((P("A"), Not(P("B or C"))))), ("A and not B", And((P("A"), Not(P("B"))))), ("not A", Not(P("A"))),
        ("A not B not C", And((P("A"), Not(P("B")), Not(P("C"))))), (" A", P(" A")),
    ],
)
def test_parse(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "A and", "and A", "A or", "A not", "A and and B", "A and "])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


CASES = [
    (["a ERROR x", "b WARNING x", "c ERROR y"], [("ERROR or WARNING and x", {1, 2}), ("ERROR not x", {3}), ("ERROR and not x", {3}), ("not ERROR", {2})]),
    (["x B or C", "x B", "x C"], [("x not B or C", {2, 3})]),
    (["this and that"], [("and", {1})]),
    (["k=abXcd", "k=ab cd"], [("ab*cd", {1}), ("ab*", {1, 2}), ("*b*", {1, 2})]),
    (["ab xc", "b c"], [("b c", {2})]),
    (["v=1", "v=2"], [("V0", set())]),
    (["id=1.2.3", "id=x"], [(".", {1})]),
    (["café ouvert", "cafe"], [("café", {1})]),
    (["Error", "ERROR"], [("ERROR and ERROR", {2}), ("ERROR AND ERROR", {2})]),
    (["a  b"], [("a b", set()), ("a  b", {1})]),
    (["a\tb:c=d,e"], [("a\tb", {1}), ("b:c=d,e", {1})]),
    (["100%_done", "100x done", "a.b(c)"], [("100%_d", {1}), ("a.b(c)", {3})]),
    (["", "x\r"], [("x", {2})]),
]


@pytest.mark.parametrize("lines, asked", CASES)
def test_search(spark, lines, asked):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "line_no long, line string")
    for text, want in asked:
        assert {r["line_no"] for r in scan(df, text).collect()} == want, text


def test_text_source(spark, tmp_path):
    from timberline.sources.corpus import numbered, read_text

    (tmp_path / "1.log").write_bytes("one\r\n\ntwo café\nlast".encode())
    (tmp_path / "2.log").write_bytes(b"")
    got = read_text(spark, numbered(str(tmp_path), 1, 2))
    assert sorted(r["line"] for r in got.collect()) == ["", "last", "one\r", "two café"]
    assert read_text(spark, str(tmp_path), min_bytes=1024).count() == 0
    assert got.where(F.col("line") == "last").count() == 1
