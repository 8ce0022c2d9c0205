import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from timberline.llm import chat, common, decontam, html, langid, mixing, ngram_join, quality, queries, spotsigs, suffix_dedup, tokens

from . import plain

SMALL = "/root/testdata/sf0.001"
LONG = "word " * 30_000
EXTRA = "n long, v long, key string, size long, h string, part int, label long, row long, z string, a long, b long, doc long"


def edge_docs(spark, rows=None):
    """Nulls, empty and long texts, ties, repeated rows; extra columns with clashing names."""
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 6)))
    base = " ".join(word() for _ in range(400))
    rows = rows or [
        (0, None, "x"), (1, "", "x"), (2, " \n\t ", None), (3, "one", "y"), (4, "One", "y"), (5, "two words", None),
        (6, base, "x"), (7, base, "x"), (8, base[:900] + " changed " + base[905:], "y"), (9, LONG, "z"),
        (10, "Ünïcode ŧext ßtraße 日本語 " + base[100:700], "z"), (11, "<|im_end|> \x1c\x85\xa0 é Σ <|endoftext|>x", "z"),
        (12, "%%% !!! ...", ""), (13, base[200:500] * 2, "x"), (14, "aaaa" * 200, "x"), (15, "aaaa" * 150, "q"),
    ]
    fill = [(i, None, "k", i, None, 0, i, 1, "z", 1, 2, 3) for i in range(len(rows))]
    return spark.createDataFrame([(*r, *f) for r, f in zip(rows, fill, strict=True)], f"doc_id long, text string, source string, {EXTRA}")


def empty(spark):
    return edge_docs(spark).where("false")


def small(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(200, i) for i in range(201, 260)]
    got = dict(common.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 260)} == {200}


def test_likely_and_settled(spark, monkeypatch):
    monkeypatch.setattr(common, "MARKS", 1 << 9)
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("x").alias("text"))
    wanted = spark.range(0, 2000, 97).select(F.col("id").alias("w"))
    got = {r["k"] for r in common.likely(rows, "k", wanted, "w").collect()}
    assert set(range(0, 2000, 97)) <= got and len(got) < 400
    nulls = spark.createDataFrame([(None,), (5,)], "k long")
    assert common.likely(nulls, "k", nulls.where("k is null"), "k").count() == 1
    held = common.settle(rows, "rows")
    assert held.count() == 2000
    common.discard(held)
    with pytest.raises(Exception, match="(?i)not.*exist"):
        held.count()


def test_mixing_targets(spark):
    for sizes in ([100, 5, 0, 7], [1], [10, 10, 10], [1000, 1, 1, 1, 1]):
        weights = [1 + i % 3 for i in range(len(sizes))]
        got = mixing.water_fill(spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight int"))
        got = [r["target"] for r in got.orderBy("source").collect()]
        assert got == pytest.approx(plain.water_fill(list(zip(sizes, weights))))


def test_mixing_rows(spark):
    docs = small(spark, "documents")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, r["target"], 0])
        s[0] += r["taken"]
        s[2] = max(s[2], r["size"])
    assert all(abs(taken - target) <= 1.5 * big for taken, target, big in by.values())
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(5)).collect())
    edge = edge_docs(spark)
    assert mixing.mix(edge).count() == edge.count() and mixing.mix(empty(spark)).count() == 0
    taken = {r["doc_id"]: r["reps"] for r in mixing.mix(edge).collect()}
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns and {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}


def test_chat(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "a <|im_end|> <\\| b"), (1, 2, "assistant", "<|x|>\n<\\\\|y"), (2, 0, "assistant", None),
        (3, None, "us\\er\n<|", "t"), (3, 5, None, ""), (4, 1, "user", "q"), (4, 2, "assistant", "x<"), (4, 2, "assistant", "x<"),
        (None, 1, "user", "m"), (None, 2, "assistant", "n"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, segments string, formatted string")
    out = chat.format_chats(df)
    made = {r["conv_id"]: r for r in out.collect()}
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [r[2:] for r in rows[:3]]
    assert [(t["role"], t["text"]) for t in back[3]["turns"]] == [("us\\er\n<|", "t"), ("", "")]
    assert back[1]["loss_text"] == rows[2][3] and made[1]["valid"] and not made[2]["valid"] and made[2]["bad_turn"] == 0
    assert back[4]["loss_text"] == "x<x<" and made[4]["bad_turn"] == 2 and made[4]["formatted"].count("<|im_end|>") == 3
    assert len(made) == len(back) == 5 and back[None]["loss_text"] == "n"
    for r in made.values():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [r["formatted"][p["start"] : p["start"] + p["length"]] for p in r["loss_spans"]] == [s["text"] for s in r["segments"] if s["loss"]]
    assert chat.digest(df.where("false")).count() == 0


def test_long_chat(spark):
    """A conversation of very many turns is formatted and read back in seconds."""
    n = 40_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    rows = spark.range(n).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("é <|im_end|> "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    got = chat.digest(rows).first()
    texts = [f"é <|im_end|> {i}" for i in range(n)]
    assert got["n_turns"] == n and got["valid"] and got["loss_chars"] == sum(map(len, texts[1::2]))
    assert got["loss_sha256"] == hashlib.sha256("".join(texts[1::2]).encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{('user', 'assistant')[i % 2]}\n{t}\n" for i, t in enumerate(texts)).encode()).hexdigest()
    assert time.time() - began < 60


def test_decontamination(spark, monkeypatch):
    random.seed(5)
    word = lambda: random.choice(["the", "of", "a", "Xy", "é", "7"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 10, 11, 3, 1, 2, 0, 10, 14])] + [(20, None), (21, "The of-a"), (22, "the OF a")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row long")
    texts = [" ".join(word() for _ in range(120)) for _ in range(20)] + [t[5:] + " zz " + u for (_, t), (_, u) in zip(items[:4], items[4:8])] + [None, "", "!?"]
    docs = edge_docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    want = {i: plain.leaks(t, items) for i, t in enumerate(texts)}
    take = lambda df: {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in df.collect()}
    assert take(decontam.leak_report(docs, bench)) == want
    monkeypatch.setattr(decontam, "PART_BYTES", 30)
    assert take(decontam.leak_report(docs, bench)) == want
    assert decontam.leak_report(docs.union(docs), bench).count() == 2 * len(texts)
    assert decontam.leak_report(empty(spark), bench).count() == 0
    assert {r["n_hit"] for r in decontam.leak_report(docs, bench.where("false")).collect()} == {0}


def test_fingerprints(spark):
    for docs in (small(spark, "documents"), edge_docs(spark)):
        rows = {r["doc_id"]: r for r in spotsigs.edited_likeness(docs).collect()}
        texts = {d: t or "" for d, t in pairs(docs)}
        assert len(rows) == len(texts)
        order = sorted(texts, reverse=True)
        by_text = {}
        for d, after in zip(order, [*order[1:], order[0]]):
            k = len(texts[d]) // 3
            edited = texts[d][: len(texts[d]) - k] + texts[after][:k]
            assert rows[d]["n_chars"] == len(texts[d]) and rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert by_text.setdefault(texts[d], rows[d]["fingerprint"]) == rows[d]["fingerprint"] == spotsigs.pack(spotsigs.spots(texts[d]))
            assert rows[d]["edited_fingerprint"] == spotsigs.pack(spotsigs.spots(edited))
            assert 0 <= rows[d]["near_next"] <= 1 and 0 <= rows[d]["near_edited"] <= 1
    rows = spotsigs.edited_likeness(small(spark, "documents")).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95
    assert spotsigs.edited_likeness(edge_docs(spark).union(edge_docs(spark))).count() == 32
    assert spotsigs.edited_likeness(empty(spark)).count() == 0


def test_fingerprints_across_limits():
    """Texts that share most of their words or characters are alike at any length and share of anchors."""
    prose = "The house of the old miller stands in a valley that few people know and it was empty for years. " * 40
    names = " ".join(f"name{i} place{i % 7}" for i in range(400))
    signs = "".join(random.Random(4).choices("#=+*/%", k=200))
    for whole in (prose, names, names[:3000] + prose, prose[:200] + names, signs, "Mentmentan.", "日本語" + "漢字仮名交文章例" * 9):
        for n in (11, 55, 60, 61, 80, 90, 300, 499, 500, 501, 520, 700, 745, 760, 2000, len(whole)):
            text = whole[:n]
            k = len(text) // 3
            edited = text[: len(text) - k] + " other words entirely in their place"[:k]
            assert spotsigs.likeness(spotsigs.spots(text), spotsigs.spots(edited)) > 0.1, (text[:20], n)
            longer = spotsigs.spots(text + " and so on")
            assert spotsigs.likeness(spotsigs.spots(text), longer) > 0.25, (text[:20], n)
    assert all(len(spotsigs.spots(t)) for t in ("!", "a", " ", "é", "%%%", "\ud800"))


def test_fingerprint_pairs(spark):
    docs = small(spark, "documents")
    prints = spotsigs.fingerprints(docs)
    got = {(r["a"], r["b"]) for r in spotsigs.spot_pairs(prints, 0.8).collect()}
    least = {}
    for d, t in sorted(pairs(docs)):
        s = spotsigs.spots(t)
        if len(s):
            least.setdefault(s.tobytes(), (d, s))
    every = list(least.values())
    want = {(min(a, b), max(a, b)) for i, (a, s) in enumerate(every) for b, t in every[:i] if spotsigs.likeness(s, t) >= 0.8}
    assert got == want


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 127, 128, 129, 5000):
        for ids in (rng.integers(0, tokens.VOCABULARY, n), np.zeros(n, int), np.arange(n) % 7):
            data = tokens.encode_block(ids)
            back, at = tokens.decode_block(data)
            assert (back == ids).all() and at == len(data)
    broken = bytearray(tokens.encode_block(np.arange(300)))
    broken[-9] ^= 1
    broken[900 if len(broken) > 950 else len(broken) // 2] ^= 255
    with pytest.raises(ValueError):
        tokens.decode_block(bytes(broken))


def test_token_ids(spark, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    for docs in (small(spark, "documents"), edge_docs(spark)):
        start = 0
        rows = {r["doc_id"]: r for r in tokens.token_table(docs, queries.tokenizer_path()).collect()}
        assert len(rows) == docs.count()
        for d, t in sorted(pairs(docs)):
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
            assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (start, len(ids), plain.crc(ids))
            start += len(ids)
    assert tokens.token_table(empty(spark), queries.tokenizer_path()).count() == 0
    both = edge_docs(spark).union(edge_docs(spark))
    assert tokens.token_table(both, queries.tokenizer_path()).count() == 32


def test_main_text(spark):
    page = lambda i, body, host="h.example": (i, f"http://{host}/{i}", f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}")
    menu = "<ul><li>Home and start page of ours<li>All our many fine products here</ul>"
    rows = [
        page(1, f"<nav>x</nav><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four</article><footer>f</footer>"),
        page(2, f"<div>{menu}</div><div><p>Unique words that only this page has.</div>"),
        page(3, f"<div>{menu}</div><div><p>Other words, found on the third page.</div><div class='comments'>c</div>"),
        (4, None, None), (5, "", ""), page(6, "<script>if (a<b) x='</p>'</script>5 < 6 &lt;b&gt; &#233;"),
    ]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, row long, host string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[1] == "A & B\n\none two three\n\nfour"
    assert got[2] == "Unique words that only this page has." and got[3] == "Other words, found on the third page."
    assert got[4] == got[5] == "" and got[6] == "5 < 6 <b> é"
    assert html.extract(df.where("false")).count() == 0


def test_blocks():
    text = lambda body: "|".join(t for k, t in html.blocks(f"<html><body>{body}") if k in ("main", "open"))
    assert text('<main><p data-id="nav">a</p><p data-role="share">b</p><p title=\'class="ad"\'>c</p></main>') == "a|b|c"
    assert text('<main><article><p>a</p></article><article class="comment"><p>x</p></article><article class="comment-body even">y</article></main>') == "a"
    assert text('<article class="post has-comments has-sidebar"><p>a</p><div class="comments">x</div><aside>y</aside></article>') == "a"
    assert text('<div role="main"><p>a</p><nav>x</nav></div><div role="navigation">y</div>') == "a"
    assert text("<p>a<form>x</form><p id=cookie-notice>y<p>b") == "a|b" and text("") == text("<") .strip("<") == ""


def test_main_text_is_plain(spark):
    """Pages with and without articles, copies of pages, repeated and missing page_ids, a very long page."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    common = [text(n) for n in (3, 6, 9, 20)]
    rows = []
    for i in range(60):
        body = "".join(f"<div>{rng.choice((rng.choice(common), text(rng.randint(1, 15)), rng.choice(common) + ' ' + text(9)))}</div>" for _ in range(rng.randint(0, 6)))
        body += rng.choice(("", f"<article><p>{text(12)}<p>{common[3]}</article>", f"<nav>{common[1]}</nav>"))
        rows.append((rng.choice((i, i, None, 7)), rng.choice((None, f"http://h{i % 3}.example/{i}")), f"<body>{body}</body>"))
    rows += rows[:9] + [(99, "http://h1.example/long", f"<p>{text(40_000)}<p>{common[2]}")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, row long, host string")
    got = sorted((repr(r["page_id"]), repr(r["url"]), r["text"], r["n_chars"]) for r in html.extract(df.repartition(5), chunk=16).collect())
    want = plain.main_texts([(url, html.blocks(body)) for _, url, body in rows])
    assert got == sorted((repr(p), repr(u), t, len(t)) for (p, u, _), t in zip(rows, want))
    assert any(t == "" for t in want) and len({t for t in want if t}) > 40


def test_suffix_array_runs():
    rng = random.Random(2)
    pages = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 40))]) for i in range(12)]
    runs = {}
    for p, t in pages:
        for i in range(len(t) - 5):
            runs.setdefault(" ".join(t[i : i + 6]), []).append(p)
    want = {html.xxhash.xxh3_64_intdigest(k) - (1 << 63): (min(v), max(v)) for k, v in runs.items()}
    assert {h: (min(a, b), max(a, b)) for h, a, b in html.long_runs(pages)} == want


def test_languages(spark):
    docs = small(spark, "documents").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = langid.languages(docs).collect()
    true = {}
    for r in docs.select("doc_id", "lang").collect():
        true.setdefault(r["doc_id"], r["lang"])
    held = [r for r in langid.languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held if r["doc_id"] >= 200]) > 0.97
    assert np.mean([r["accepted"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    edge = edge_docs(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit("x"))
    assert {r["lang_pred"] for r in langid.languages(edge).collect()} == {"und"}
    found = langid.identify(edge, langid.fit(docs.limit(50)))
    assert found.count() == 16 and {r["lang_pred"] for r in found.where("doc_id in (0, 1, 2, 12)").collect()} == {"und"}


def test_language_by_plain_compression(spark):
    """Each piece pressed with each dictionary by itself; the smallest sum wins."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    settings = zstandard.ZstdCompressionParameters.from_level(6, **langid._PARAMETERS)
    raw = {k: zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in model}
    fast = langid.Classifier(model)
    for r in docs.where("doc_id % 20 = 1").collect():
        text = " " + " ".join("".join(c if c.isalpha() else " " for c in r["text"].lower()).split()) + " "
        if text != langid.letters(r["text"]).decode():
            continue
        b = text.encode()
        n = max(1, round(len(b) / langid.PIECE))
        step = -(-len(b) // n)
        sums = {k: sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress(b[i : i + step])) for i in range(0, len(b), step)) for k, d in raw.items()}
        best = min(sums, key=lambda k: (sums[k], k))
        got = fast.predict(r["text"])
        assert got[0] == (best if text.strip() else "und") and (len(sums) < 2 or got[2] >= 0)


def components(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_ngram_components(spark):
    for docs, opts in ((spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), {}), (small(spark, "documents"), {"width": 5, "num": 80}), (edge_docs(spark), {})):
        assert components(ngram_join.link_components(docs, **opts)) == plain.components(pairs(docs), **opts)


def test_ngram_lists_are_kept_once(spark, monkeypatch):
    rng, rows, kept, settle = random.Random(5), [], {}, ngram_join.settle

    def counted(df, name):
        out = settle(df, name)
        kept.setdefault(name, out.count())
        return out

    monkeypatch.setattr(ngram_join, "settle", counted)
    for copies in (2, 3, 5, 4):
        for length in (60, 150, 700):
            words = [f"w{rng.random()}" for _ in range(length)]
            for i in range(copies):
                own = [*words[:-1], *(f"e{rng.random()}" for _ in range(1 + i * length // 25))]
                rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert components(ngram_join.link_components(docs)) == plain.components(pairs(docs))
    # each set of vertices once, however many keys its vertices share
    assert kept["twos"] <= 12 * 10 and kept["lists"] <= 3 * len(rows)


def test_ngram_entries_without_a_partner_go(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GATHERED", 5)
    # of 100 shingles each, two need r = 7; other sizes are not alike
    keys = [(1, 10, 100, 12), (1, 11, 100, 12), (1, 12, 500, 60), (2, 10, 100, 9), (2, 11, 100, 9), (2, 13, 100, 3), (3, 10, 100, 5), (3, 11, 100, 12), (3, 14, 200, 12)]
    keys += [(k, v, n, 12 - k) for k in (4, 5) for v, n in ((20, 100), (21, 101), (22, 102), (20 + 10 * k, 1000))]
    keys += [(6, v, 100 + v * v, 2) for v in range(70, 76)]  # too long to be gathered: stays whole
    twos, lists = ngram_join.group_keys(spark.createDataFrame(keys, "key long, v long, n long, r int"), 90, 100)
    assert [tuple(r) for r in twos.collect()] == [(10, 11, 2)]
    assert sorted(tuple(r)[1:] for r in lists.collect()) == [(20, 100, 8, 2), (21, 101, 8, 2), (22, 102, 8, 2), *((v, 100 + v * v, 2, 1) for v in range(70, 76))]


def test_ngram_join_leaves_no_shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = held.getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    before, given = shuffled(), spark.conf.get(*common.SWEPT, None)
    ngram_join.link_components(small(spark, "documents"))
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(*common.SWEPT, None) == given


def test_ngram_components_near_the_threshold(spark):
    rng = random.Random(8)
    rows, n = [], 0
    for size in (3, 5, 9, 12, 13, 20, 21, 40, 60):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        for edits in range(6):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            rows.append((n, " ".join(w[: len(w) - edits // 2]), None))
            n += 1
    docs = edge_docs(spark, rows)
    for num in (50, 80, 90):
        assert components(ngram_join.link_components(docs, num=num)) == plain.components(pairs(docs), num=num)
    assert ngram_join.link_components(empty(spark)).count() == 0
    twice = components(ngram_join.link_components(docs.union(docs)))
    assert twice == plain.components(pairs(docs)) and ngram_join.link_components(docs.union(docs)).count() == 2 * n


def removed(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_repeated_bytes(spark, monkeypatch):
    assert removed(suffix_dedup.dedup(small(spark, "documents"))) == plain.repeated_bytes(pairs(small(spark, "documents")))
    docs = edge_docs(spark)
    assert removed(suffix_dedup.dedup(docs)) == plain.repeated_bytes(pairs(docs))
    rng = random.Random(4)
    parts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (30, 60, 99, 100, 101, 150, 400)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 7))), None) for i in range(40)]
    docs = edge_docs(spark, rows)
    want = plain.repeated_bytes(pairs(docs))
    monkeypatch.setattr(suffix_dedup, "STRETCH", 500)
    assert removed(suffix_dedup.dedup(docs.repartition(3))) == want
    assert removed(suffix_dedup.dedup(docs.union(docs))) == want
    assert suffix_dedup.dedup(empty(spark)).count() == 0


def test_repeated_bytes_under_one_id(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, other = text(150), text(260), text(400)
    for rows in (
        [(1, a, None), (2, a + b, None), (2, other, None)],
        [(1, a, None), (1, b + a, None), (3, b, "x")],
        [(None, a, None), (None, a, None), (None, b + a, None), (0, b, None), (0, None, None), (5, a + other, None), (5, a + other, None), (4, other, None)],
    ):
        docs = edge_docs(spark, rows)
        # each (id, text) is a document of its own; its number keeps the order of ids
        order = sorted({(r["key"], r["doc_id"], r["text"]) for r in suffix_dedup.keyed(docs).collect()})
        assert [d for _, d, _ in order] == sorted((d for _, d, _ in order), key=lambda d: -1 if d is None else d)
        assert len(order) == len(set(rows)) and len({k for k, _, _ in order}) == len(order)
        want = plain.repeated_bytes([(k, t) for k, _, t in order])
        by_text = {(d, t): want[k] for k, d, t in order}
        got = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect())
        assert got == sorted((repr(d), *by_text[(d, t)]) for d, t, _ in rows)


def test_repeated_bytes_with_common_anchors(spark, monkeypatch):
    """One 60-byte string in unlike surroundings all over: its segments are dealt by their refined bucket."""
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, longer = text(60), text(130)
    rows = [(i, "".join(rng.choice((line, line + text(45), longer, text(70))) for _ in range(rng.randint(1, 9))), None) for i in range(60)]
    docs = edge_docs(spark, rows)
    want = plain.repeated_bytes(pairs(docs))
    monkeypatch.setattr(suffix_dedup, "SAMPLE_EVERY", 1)
    monkeypatch.setattr(suffix_dedup, "COMMON", 5)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    assert len(suffix_dedup.common_anchors(suffix_dedup.keyed(docs))) > 0
    assert removed(suffix_dedup.dedup(docs.repartition(5))) == want


def test_bucket_refinement():
    rng = random.Random(11)
    texts = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) * rng.randint(1, 20)).encode() for _ in range(60)]
    s = suffix_dedup.Stretch(texts, suffix_dedup._Powers())
    raw, seen, want = b"".join(texts), set(), []
    for at in s.window_starts():
        want.append(raw[at : at + 100] in seen)
        seen.add(raw[at : at + 100])
    assert s.repeated_here(s.window_starts()).tolist() == want


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.classify(docs).join(labels, "doc_id").collect()
    assert np.mean([r["keep"] == bool(r["quality"]) for r in rows]) > 0.93
    assert np.mean([r["keep"] for r in rows if r["quality"]]) > 0.97
    edge = {r["doc_id"]: r for r in quality.classify(edge_docs(spark)).collect()}
    assert len(edge) == 16 and not edge[0]["keep"] and edge[6]["score"] == edge[7]["score"]
    assert quality.classify(empty(spark)).count() == 0


def test_label_model():
    """Pattern counts give what expectation-maximisation row by row gives; accuracies come out as votes were drawn."""
    rng = random.Random(13)
    right = [0.95, 0.9, 0.7, 0.85] + [0.8] * (len(quality.LABELLERS) - 4)
    true = [rng.random() < 0.75 for _ in range(400)]
    rows = [[rng.choice((0, 1)) and (1 if (rng.random() < r) == t else -1) for r in right] for t in true]
    counts = {}
    for v in rows:
        counts[tuple(v)] = counts.get(tuple(v), 0) + 1
    start = quality.LabelModel({})
    model = quality.LabelModel(counts, rounds=15)
    assert model.posterior(rows) == pytest.approx(plain.em(rows, start.share_good, start.chance.tolist(), 15), abs=1e-6)
    assert np.mean([(p > 0.5) == t for p, t in zip(model.posterior(rows), true)]) > 0.95
    found = list(quality.LabelModel(counts).accuracies().values())
    assert found[:4] == pytest.approx(right[:4], abs=0.12)


def test_quality_edges(spark):
    docs = edge_docs(spark)
    once = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    twice = quality.classify(docs.union(docs)).collect()
    assert len(twice) == 32 and all(sum(r["doc_id"] == d for r in twice) == 2 for d in once)
    assert {r["score"] for r in twice if r["doc_id"] == 6} == {r["score"] for r in twice if r["doc_id"] == 7}
    assert once[0]["score"] == once[1]["score"] == once[0]["posterior"] == 0 and not once[1]["keep"]
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert quality.classify(nulls).count() == 16
    a, b = quality.train(docs), quality.train(docs.repartition(3))
    assert np.allclose(a[1].w, b[1].w)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    for t in ("documents", "benchmark", "conversations"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = duckdb.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SMALL)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    plain_rows = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain_rows(got.select(*cols).collect()) == plain_rows(want.select(", ".join(cols)).fetchall())


def test_no_python_on_native_paths(spark):
    for f in (queries.op1_mix_sources, queries.op2_format_chats):
        plan = f(spark, SMALL)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
