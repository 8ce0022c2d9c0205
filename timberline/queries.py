"""The engine's own queries over the driver's tables, each with its SQL twin where there is one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import mining, rowsets
from .plans import catalog
from .plans.query import Common, Regex
from .plans.search import LIMIT, scan, search
from .sources import store
from .sources.corpus import CORPORA

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}

EVENTS = """SELECT event_id // 2500 AS block_id, event_id AS line_no, ts::VARCHAR || ' ' || upper(event_type) || ' user=' || user_id::VARCHAR || ' value=' || value::VARCHAR || ' props:' || props AS line FROM events"""
ORDERS = """SELECT o_orderkey // 2500 AS block_id, o_orderkey AS line_no, 'order=' || o_orderkey::VARCHAR || ' cust=' || o_custkey::VARCHAR || ' status:' || o_orderstatus || ' prio=' || o_orderpriority AS line FROM orders"""


def _pieces(table: str, key: str, col: str) -> str:
    return f"SELECT k AS block_id, k * 10000000 + i - 1 AS line_no, line FROM (SELECT {key} AS k, unnest(string_split({col}, chr(10))) AS line, unnest(generate_series(1, len(string_split({col}, chr(10))))) AS i FROM {table})"


LINES = {"events": EVENTS, "orders": ORDERS, "docs": _pieces("documents", "doc_id", "text"), "conversations": _pieces("conversations", "conv_id * 100000 + turn", "text"), "pages": _pieces("pages", "page_id", "html")}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


#: name, corpus, query, the same condition in SQL
SEARCHES = (
    ("q01_constant", "orders", "status", "contains(line, 'status')"),
    ("q02_variable", "events", "CLICK", "contains(line, 'CLICK')"),
    ("q03_absent", "events", "NOSUCHTOKEN", "contains(line, 'NOSUCHTOKEN')"),
    ("q04_phrase_blank", "events", "SIGNUP user", "contains(line, 'SIGNUP user')"),
    ("q05_phrase_equals", "events", "user=8", "contains(line, 'user=8')"),
    ("q06_phrase_colon", "orders", "status:F prio", "contains(line, 'status:F prio')"),
    ("q07_and", "events", "ERROR and user=8", "contains(line, 'ERROR') AND contains(line, 'user=8')"),
    ("q08_and_and", "events", "ERROR and user=8 and value=1", "contains(line, 'ERROR') AND contains(line, 'user=8') AND contains(line, 'value=1')"),
    ("q09_or", "events", "ERROR or SIGNUP", "contains(line, 'ERROR') OR contains(line, 'SIGNUP')"),
    ("q10_or_before_and", "events", "ERROR or CLICK and user=8 not props:{\"k\": 6", "(contains(line, 'ERROR') OR contains(line, 'CLICK')) AND contains(line, 'user=8') AND NOT contains(line, 'props:{\"k\": 6')"),
    ("q11_not", "events", "ERROR not user=8", "contains(line, 'ERROR') AND NOT contains(line, 'user=8')"),
    ("q12_and_not", "events", "ERROR and not user=8", "contains(line, 'ERROR') AND NOT contains(line, 'user=8')"),
    ("q13_not_not", "events", "ERROR not user=8 not value=1", "contains(line, 'ERROR') AND NOT contains(line, 'user=8') AND NOT contains(line, 'value=1')"),
    ("q14_leading_not", "events", "not ERROR", "NOT contains(line, 'ERROR')"),
    ("q15_or_in_not", "events", "CLICK not user=8 or SIGNUP", "contains(line, 'CLICK') AND NOT contains(line, 'user=8 or SIGNUP')"),
    ("q16_outer_wildcard", "docs", "*tion*", "contains(line, 'tion')"),
    ("q17_inner_wildcard", "docs", "th*ing", "regexp_matches(line, 'th[^ \\t:=,]*ing')"),
    ("q18_many_bytes", "docs", "é and la", "contains(line, 'é') AND contains(line, 'la')"),
    ("q19_page_markup", "pages", "class=\"ad\" and footer", "contains(line, 'class=\"ad\"') AND contains(line, 'footer')"),
    ("q20_conversations", "conversations", "the or und not der", "(contains(line, 'the') OR contains(line, 'und')) AND NOT contains(line, 'der')"),
)
for _name, _corpus, _text, _where in SEARCHES:
    _add(_name, f"SELECT block_id, line_no, line FROM ({LINES[_corpus]}) WHERE {_where}")(lambda s, d, c=_corpus, t=_text: scan(CORPORA[c](s, d), t))

TOKENS_SQL = r"regexp_extract_all(line, '[^ \t:=,]+|[ \t:=,]')"
WORDS_SQL = r"regexp_extract_all(line, '[^ \t:=,]+')"
SKELETON_SQL = r"regexp_replace(line, '[^ \t:=,]+', 'W', 'g')"


def _mask_sql(v: str) -> str:
    return "(" + " | ".join(f"(CASE WHEN regexp_matches({v}, '{p}') THEN {b} ELSE 0 END)" for p, b in X.CLASSES) + ")"


@_add("q21_regex", f"SELECT block_id, line_no, line FROM ({EVENTS}) WHERE regexp_matches(line, 'user=[0-9]*7 value=1[0-9][.]')")
def _regex(s: SparkSession, d: str) -> DataFrame:
    return CORPORA["events"](s, d).where(Regex("user=[0-9]*7 value=1[0-9][.]").column(F.col("line")))


@_add("q22_token_counts", f"SELECT line_no, len({TOKENS_SQL}) AS n_tokens, array_to_string({TOKENS_SQL}, '') = line AS same FROM ({EVENTS})")
def _token_counts(s: SparkSession, d: str) -> DataFrame:
    t = X.tokens(F.col("line"))
    return CORPORA["events"](s, d).select("line_no", F.size(t).alias("n_tokens"), (X.join_tokens(t) == F.col("line")).alias("same"))


@_add("q23_top_tokens", f"SELECT w, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS w FROM ({LINES['docs']})) GROUP BY w ORDER BY n DESC, w LIMIT 25")
def _top_tokens(s: SparkSession, d: str) -> DataFrame:
    return CORPORA["docs"](s, d).select(F.explode(X.words(F.col("line"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(25)


@_add("q24_masks", f"SELECT w, {_mask_sql('w')} AS mask, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS w FROM ({EVENTS})) GROUP BY w")
def _masks(s: SparkSession, d: str) -> DataFrame:
    w = CORPORA["events"](s, d).select(F.explode(X.words(F.col("line"))).alias("w"))
    return w.groupBy("w").agg(F.count("*").alias("n")).select("w", X.class_mask(F.col("w")).alias("mask"), "n")


_WORD_AT = f"SELECT line_no, unnest(generate_series(0, len(ws) - 1)) AS pos, unnest(ws) AS w FROM (SELECT line_no, {WORDS_SQL} AS ws FROM ({{}}))"


@_add("q25_position_stats", f"SELECT pos, bit_or({_mask_sql('w')}) AS mask, min(length(w)) AS min_len, max(length(w)) AS max_len, count(DISTINCT w) AS n_distinct FROM ({_WORD_AT.format(EVENTS)}) GROUP BY pos")
def _position_stats(s: SparkSession, d: str) -> DataFrame:
    w = CORPORA["events"](s, d).select(F.posexplode(X.words(F.col("line"))).alias("pos", "w"))
    return w.groupBy("pos").agg(F.bit_or(X.class_mask(F.col("w"))).alias("mask"), F.min(F.length("w")).alias("min_len"), F.max(F.length("w")).alias("max_len"), F.countDistinct("w").alias("n_distinct"))


@_add(
    "q26_top_shapes",
    f"""WITH s AS (SELECT pos, regexp_replace(w, '[0-9A-Za-z]+', 'V', 'g') AS shape, count(*) AS n FROM ({_WORD_AT.format(EVENTS)}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, shape) AS r FROM s)
SELECT pos, CASE WHEN r <= 3 THEN shape ELSE 'other' END AS shape, sum(n)::BIGINT AS n FROM r GROUP BY 1, 2""",
)
def _top_shapes(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = CORPORA["events"](s, d).select(F.posexplode(X.words(F.col("line"))).alias("pos", "w"))
    n = w.groupBy("pos", X.shape(F.col("w")).alias("shape")).agg(F.count("*").alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("n"), "shape")))
    return r.groupBy("pos", F.when(F.col("r") <= 3, F.col("shape")).otherwise("other").alias("shape")).agg(F.sum("n").alias("n"))


@_add("q27_count_by_block", f"SELECT block_id, count(*) AS n FROM ({EVENTS}) WHERE contains(line, 'ERROR') GROUP BY block_id")
def _count_by_block(s: SparkSession, d: str) -> DataFrame:
    return scan(CORPORA["events"](s, d), "ERROR").groupBy("block_id").agg(F.count("*").alias("n"))


@_add("q28_modes", f"WITH c AS (SELECT pos, w, count(*) AS n FROM ({_WORD_AT.format(ORDERS)}) GROUP BY 1, 2), l AS (SELECT pos, length(w) AS len, sum(n) AS n FROM c GROUP BY 1, 2), a AS (SELECT pos, w, row_number() OVER (PARTITION BY pos ORDER BY n DESC, w) AS r FROM c), b AS (SELECT pos, len, row_number() OVER (PARTITION BY pos ORDER BY n DESC, len) AS r FROM l) SELECT a.pos, a.w AS value, b.len AS length FROM a JOIN b ON a.pos = b.pos AND a.r = 1 AND b.r = 1")
def _modes(s: SparkSession, d: str) -> DataFrame:
    w = CORPORA["orders"](s, d).select(F.posexplode(X.words(F.col("line"))).alias("pos", "w"))
    c = w.groupBy("pos", "w").agg(F.count("*").alias("n"))
    a = c.groupBy("pos").agg(F.min(F.struct(-F.col("n"), F.col("w").alias("w")))["w"].alias("value"))
    n = c.groupBy("pos", F.length("w").alias("len")).agg(F.sum("n").alias("n"))
    b = n.groupBy("pos").agg(F.min(F.struct(-F.col("n"), F.col("len").alias("len")))["len"].alias("length"))
    return a.join(b, "pos")


MINED_SQL = """WITH l AS (SELECT line_no, line, {sk} AS skeleton, {ws} AS ws FROM ({lines})),
p AS (SELECT skeleton, unnest(generate_series(1, len(ws))) AS pos, unnest(ws) AS w FROM l {sample}),
c AS (SELECT skeleton, pos, count(*) AS n, CASE WHEN min(w) = max(w) THEN min(w) END AS word FROM p GROUP BY 1, 2),
t0 AS (SELECT skeleton, max(n) AS n_rows, list(word ORDER BY pos) AS slots FROM c GROUP BY skeleton),
t AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, skeleton) - 1 AS eid FROM t0),
m AS (SELECT l.line_no, l.line, CASE WHEN t.eid IS NOT NULL AND list_bool_and(list_transform(list_zip(t.slots, l.ws), lambda z: z[1] IS NULL OR z[1] = z[2])) THEN t.eid ELSE -1 END AS eid, l.ws, t.slots FROM l LEFT JOIN t USING (skeleton)),
v AS (SELECT eid, line_no, unnest(generate_series(0, len(vs) - 1)) AS var_idx, unnest(vs) AS value FROM (SELECT eid, line_no, list_transform(list_filter(list_zip(slots, ws), lambda z: z[1] IS NULL), lambda z: z[2]) AS vs FROM m WHERE eid >= 0)) """


def _mined_sql(corpus: str, sample: bool = False) -> str:
    return MINED_SQL.format(sk=SKELETON_SQL, ws=WORDS_SQL, lines=LINES[corpus], sample="WHERE line_no % 100 = 1" if sample else "")


def _mined(s: SparkSession, d: str, corpus: str, sampled: bool = False) -> tuple[DataFrame, DataFrame]:
    lines = CORPORA[corpus](s, d)
    templates = mining.number(mining.mine(mining.sample(lines) if sampled else lines))
    return lines, templates


@_add("q29_skeletons", f"{_mined_sql('conversations')} SELECT skeleton, n_rows, len(slots) AS n_words, len(list_filter(slots, lambda x: x IS NULL)) AS n_slots FROM t")
def _skeletons(s: SparkSession, d: str) -> DataFrame:
    t = _mined(s, d, "conversations")[1]
    return t.select("skeleton", "n_rows", F.size("slots").alias("n_words"), F.size(F.filter("slots", lambda w: w.isNull())).alias("n_slots"))


@_add("q30_constants", f"{_mined_sql('events')} SELECT skeleton, pos, word IS NULL AS is_variable, word FROM c")
def _constants(s: SparkSession, d: str) -> DataFrame:
    t = _mined(s, d, "events")[1].select("skeleton", F.posexplode("slots").alias("pos", "word"))
    return t.select("skeleton", (F.col("pos") + 1).alias("pos"), F.col("word").isNull().alias("is_variable"), "word")


@_add("q31_template_text", "SELECT DISTINCT 0 AS eid, 'order=<V0> cust=<V1> status:<V2> prio=<V3>' AS template FROM orders UNION ALL SELECT DISTINCT 1, 'order=<V0> cust=<V1> status:<V2> prio=' || o_orderpriority FROM orders WHERE contains(o_orderpriority, ' ')")
def _template_text(s: SparkSession, d: str) -> DataFrame:
    return mining.template_text(_mined(s, d, "orders")[1]).select("eid", "template")


@_add("q32_template_counts", f"{_mined_sql('orders')} SELECT eid, count(*) AS n_rows FROM m GROUP BY eid")
def _template_counts(s: SparkSession, d: str) -> DataFrame:
    lines, t = _mined(s, d, "orders")
    return mining.match(lines, t).groupBy("eid").agg(F.count("*").alias("n_rows"))


@_add("q33_variables", f"{_mined_sql('events')} SELECT eid, line_no, var_idx, value FROM v")
def _variables(s: SparkSession, d: str) -> DataFrame:
    return mining.values(mining.match(*_mined(s, d, "events")))


@_add("q34_outlier_lines", f"{_mined_sql('docs', True)} SELECT line_no, line FROM m WHERE eid = -1")
def _outlier_lines(s: SparkSession, d: str) -> DataFrame:
    return mining.match(*_mined(s, d, "docs", True)).where("eid = -1").select("line_no", "line")


@_add("q35_rebuilt", f"SELECT line_no, line AS rebuilt FROM ({LINES['events']})")
def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    lines, t = _mined(s, d, "events", True)
    return mining.rebuild(mining.match(lines, mining.with_pieces(t), ("pieces",)), t).select("line_no", "rebuilt")


@_add(
    "q36_column_kinds",
    f"""{_mined_sql('events')} SELECT eid, var_idx, CASE WHEN count(*) < 100 THEN 'V' WHEN count(DISTINCT value) < count(*) * 0.5 THEN 'D' ELSE 'S' END AS kind, count(*) AS n_values, count(DISTINCT value) AS n_distinct,
bit_or({_mask_sql('value')}) AS char_mask, min(length(value)) AS min_len, max(length(value)) AS max_len FROM v GROUP BY eid, var_idx""",
)
def _column_kinds(s: SparkSession, d: str) -> DataFrame:
    return mining.column_meta(mining.values(mining.match(*_mined(s, d, "events")))).drop("prefix", "suffix", "pattern")


DICTIONARY_SQL = r"""e AS (SELECT eid, var_idx, value, count(*) AS n, min(line_no) AS first_line, regexp_replace(value, '[0-9A-Za-z]+', 'V', 'g') AS shape FROM v GROUP BY ALL),
s AS (SELECT eid, var_idx, shape, least(4, row_number() OVER (PARTITION BY eid, var_idx ORDER BY count(*) DESC, shape)) AS r FROM e GROUP BY eid, var_idx, shape),
dict AS (SELECT eid, var_idx, row_number() OVER (PARTITION BY eid, var_idx ORDER BY r, first_line, value) - 1 AS id, value, shape FROM e JOIN s USING (eid, var_idx, shape))"""


@_add("q37_dictionary", f"{_mined_sql('orders')}, {DICTIONARY_SQL} SELECT * FROM dict")
def _dictionary(s: SparkSession, d: str) -> DataFrame:
    return mining.dictionary(mining.values(mining.match(*_mined(s, d, "orders"))))


@_add("q38_entries_decoded", f"{_mined_sql('orders')}, {DICTIONARY_SQL} SELECT v.eid, v.var_idx, v.line_no, dict.id, v.value FROM v JOIN dict USING (eid, var_idx, value)")
def _entries(s: SparkSession, d: str) -> DataFrame:
    vals = mining.values(mining.match(*_mined(s, d, "orders")))
    words = mining.dictionary(vals)
    return mining.entries(vals, words).join(words.drop("shape"), ["eid", "var_idx", "id"]).select("eid", "var_idx", "line_no", "id", "value")


@_add("q39_padded", f"{_mined_sql('orders')}, w AS (SELECT eid, var_idx, max(length(value)) AS width FROM v GROUP BY 1, 2) SELECT eid, var_idx, line_no, repeat(' ', width - length(value)) || value AS padded, value AS unpadded FROM v JOIN w USING (eid, var_idx)")
def _padded(s: SparkSession, d: str) -> DataFrame:
    vals = mining.values(mining.match(*_mined(s, d, "orders")))
    width = vals.groupBy("eid", "var_idx").agg(F.max(F.length("value")).alias("width"))
    x = vals.join(width, ["eid", "var_idx"]).withColumn("padded", X.pad(F.col("value"), F.col("width")))
    return x.select("eid", "var_idx", "line_no", "padded", X.unpad(F.col("padded")).alias("unpadded"))


@_add("q40_value_outliers", f"{_mined_sql('events')} SELECT eid, var_idx, line_no, value FROM v WHERE NOT regexp_matches(value, '^[0-9.-]+$')")
def _value_outliers(s: SparkSession, d: str) -> DataFrame:
    return mining.value_outliers(mining.values(mining.match(*_mined(s, d, "events"))), "^[0-9.-]+$").select("eid", "var_idx", "line_no", "value")


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = CORPORA["events"](s, d)
    return lines, scan(lines, "ERROR or CLICK"), scan(lines, "user=8")


_A, _B = "(contains(line, 'ERROR') OR contains(line, 'CLICK'))", "contains(line, 'user=8')"
for _name, _f, _where in (
    ("q41_union", lambda e, a, b: rowsets.union(a, b), f"{_A} OR {_B}"),
    ("q42_intersection", lambda e, a, b: rowsets.intersect(a, b), f"{_A} AND {_B}"),
    ("q43_difference", lambda e, a, b: rowsets.difference(a, b), f"{_A} AND NOT {_B}"),
    ("q44_complement", lambda e, a, b: rowsets.complement(e, a), f"NOT {_A}"),
):
    _add(_name, f"SELECT block_id, line_no FROM ({EVENTS}) WHERE {_where}")(lambda s, d, f=_f: f(*_two(s, d)))


def _store(s: SparkSession, d: str, corpus: str) -> store.Store:
    given = s.conf.get("spark.checkpoint.dir", None)
    if not given and not s.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{given}/store-{corpus}-{uuid.uuid4().hex}" if given else tempfile.mkdtemp(prefix="timberline-store-")
    store.write(CORPORA[corpus](s, d), folder)
    return store.Store(s, folder)


@_add("q45_pruned_search", f"SELECT block_id, line_no, line FROM ({ORDERS}) WHERE contains(line, 'status:F') AND contains(line, 'cust=1') AND NOT contains(line, 'prio=1')")
def _pruned(s: SparkSession, d: str) -> DataFrame:
    return search(_store(s, d, "orders"), "status:F and cust=1 not prio=1").rows(None)


@_add("q46_limited_rows", f"SELECT block_id, line_no, line FROM ({EVENTS}) WHERE contains(line, 'ERROR') ORDER BY block_id, line_no LIMIT {LIMIT}")
def _limited(s: SparkSession, d: str) -> DataFrame:
    return search(_store(s, d, "events"), "ERROR").rows()


@_add("q47_template_list", f"{_mined_sql('orders')} SELECT eid, n_rows FROM t WHERE n_rows >= 2")
def _template_list(s: SparkSession, d: str) -> DataFrame:
    return catalog.template_list(_store(s, d, "orders"))


@_add("q48_values_like", f"{_mined_sql('orders')} SELECT line_no, value FROM v WHERE eid = 0 AND var_idx = 1 AND contains(value, '7')")
def _values_like(s: SparkSession, d: str) -> DataFrame:
    return catalog.column_values(_store(s, d, "orders"), 0, 1, "7")


#: Statistics of columns, with what all values of a column share at their ends.
META_SQL = f"""c0 AS (SELECT eid, var_idx, count(*) AS n_values, count(DISTINCT value) AS n_distinct, bit_or({_mask_sql('value')}) AS char_mask, min(length(value)) AS min_len, max(length(value)) AS max_len,
  min(value) AS lo, max(value) AS hi, min(reverse(value)) AS rlo, max(reverse(value)) AS rhi FROM v GROUP BY eid, var_idx),
c1 AS (SELECT *, CASE WHEN n_values < 100 THEN 'V' WHEN n_distinct < n_values * 0.5 THEN 'D' ELSE 'S' END AS kind,
  left(lo, list_max(list_filter(generate_series(0, least(length(lo), length(hi))), lambda i: left(lo, i) = left(hi, i)))) AS prefix,
  reverse(left(rlo, list_max(list_filter(generate_series(0, least(length(rlo), length(rhi))), lambda i: left(rlo, i) = left(rhi, i))))) AS tail FROM c0),
meta AS (SELECT * EXCLUDE tail, CASE WHEN lo <> hi AND length(prefix) + length(tail) <= min_len THEN tail ELSE '' END AS suffix FROM c1)"""
_FITS = "starts_with(value, prefix) AND ends_with(value, suffix) AND length(value) >= length(prefix) + length(suffix)"


@_add(
    "q49_column_list",
    f"""{_mined_sql('orders')}, {META_SQL} SELECT eid, var_idx, kind, n_values, n_distinct, char_mask, min_len, max_len, prefix, suffix,
CASE WHEN lo = hi THEN lo ELSE prefix || '<*>' || suffix END AS pattern FROM meta WHERE eid = 0""",
)
def _column_list(s: SparkSession, d: str) -> DataFrame:
    return catalog.column_list(_store(s, d, "orders"), 0)


@_add("q50_greedy_templates")
def _greedy(s: SparkSession, d: str) -> DataFrame:
    return mining.greedy_mine(CORPORA["events"](s, d))


@_add("q51_split_patterns")
def _split_patterns(s: SparkSession, d: str) -> DataFrame:
    return mining.split_patterns(mining.values(mining.match(*_mined(s, d, "events"))))


@_add("q52_sizes", f"SELECT block_id, count(*) AS n_lines, sum(length(line) + 1)::BIGINT AS n_chars FROM ({ORDERS}) GROUP BY block_id")
def _sizes(s: SparkSession, d: str) -> DataFrame:
    return CORPORA["orders"](s, d).groupBy("block_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line") + 1).alias("n_chars"))


@_add("q53_scalar_functions", r"SELECT line_no, w[1] AS first_word, try_cast(nullif(regexp_extract(w[3], '^\s*([+-]?[0-9]+)', 1), '') AS INTEGER) AS third, regexp_matches(w[3], '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$') AS ip FROM (SELECT line_no, regexp_extract_all(line, '[^ \t:=,]+') AS w FROM (" + ORDERS + "))")
def _scalars(s: SparkSession, d: str) -> DataFrame:
    w = X.words(F.col("line"))
    return CORPORA["orders"](s, d).select("line_no", F.get(w, F.lit(0)).alias("first_word"), X.lenient_int(F.get(w, F.lit(2))).alias("third"), X.is_ipv4(F.get(w, F.lit(2))).alias("ip"))


@_add("q54_reservoir", f"SELECT block_id, line_no, line FROM ({EVENTS}) ORDER BY md5('r1:' || block_id || ':' || line_no), block_id, line_no LIMIT 50")
def _reservoir(s: SparkSession, d: str) -> DataFrame:
    return mining.reservoir(CORPORA["events"](s, d), 50)


@_add("q55_sample_ratio", f"SELECT {SKELETON_SQL} AS skeleton, count(*) AS n_rows, count(*) FILTER (WHERE line_no % 100 = 1) AS n_sampled, count(*) FILTER (WHERE line_no % 100 = 1) / count(*) AS ratio FROM ({ORDERS}) GROUP BY 1")
def _sample_ratio(s: SparkSession, d: str) -> DataFrame:
    return mining.sample_ratio(CORPORA["orders"](s, d))


_HASH_SQL = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (a * 131 + b) & 2147483647)"


@_add(
    "q56_conversions",
    f"""SELECT line_no, trim(' ' || w[3] || ' ') AS trimmed, CASE WHEN regexp_matches(w[6], '^[+-]?[0-9]+$') THEN w[6]::BIGINT END AS as_long, try_cast(w[8] AS DOUBLE) AS as_double,
substr(w[3], 2, 3) AS piece, {_HASH_SQL.format('w[3]')} AS hash, coalesce(list_position(w, 'user'), 0)::INTEGER - 1 AS place FROM (SELECT line_no, {WORDS_SQL} AS w FROM ({EVENTS}))""",
)
def _conversions(s: SparkSession, d: str) -> DataFrame:
    w = CORPORA["events"](s, d).select("line_no", X.words(F.col("line")).alias("w"))
    at = lambda i: F.get("w", F.lit(i))
    return w.select(
        "line_no", X.trimmed(F.concat(F.lit(" "), at(2), F.lit(" "))).alias("trimmed"), X.number(at(5), "long").alias("as_long"), X.number(at(7), "double").alias("as_double"),
        X.piece(at(2), 1, 3).alias("piece"), X.hash31(at(2)).alias("hash"), X.place(F.col("w"), F.lit("user")).alias("place"),
    )


@_add(
    "q57_shape_masks",
    f"""SELECT w, array_to_string(list_transform(regexp_extract_all(w, '[0-9A-Za-z]+|[^0-9A-Za-z]'), lambda r: CASE WHEN regexp_matches(r, '^[0-9A-Za-z]') THEN '<V,' || {_mask_sql('r')} || '>' WHEN r = ' ' THEN '<-1>' ELSE r END), '') AS shape
FROM (SELECT DISTINCT unnest({WORDS_SQL}) AS w FROM ({EVENTS}))""",
)
def _shape_masks(s: SparkSession, d: str) -> DataFrame:
    w = CORPORA["events"](s, d).select(F.explode(X.words(F.col("line"))).alias("w")).distinct()
    return w.select("w", X.shape_masks(F.col("w")).alias("shape"))


@_add(
    "q58_similarity",
    f"""WITH t AS (SELECT line_no, {TOKENS_SQL} AS t FROM ({ORDERS})), p AS (SELECT a.line_no, a.t AS x, b.t AS y FROM t a JOIN t b ON b.line_no = a.line_no + 1)
SELECT line_no, CASE WHEN len(x) <> len(y) OR len(list_filter(list_zip(x, y), lambda z: (regexp_matches(z[1], '^[ \t:=,]$') OR regexp_matches(z[2], '^[ \t:=,]$')) AND z[1] <> z[2])) > 0 THEN 0.0
ELSE len(list_filter(list_zip(x, y), lambda z: z[1] = z[2])) / len(x) END::DOUBLE AS similarity FROM p""",
)
def _similarity(s: SparkSession, d: str) -> DataFrame:
    t = CORPORA["orders"](s, d).select("line_no", X.tokens(F.col("line")).alias("t"))
    nxt = t.select((F.col("line_no") - 1).alias("line_no"), F.col("t").alias("u"))
    return t.join(nxt, "line_no").select("line_no", mining.likeness(F.col("t"), F.col("u")).cast("double").alias("similarity"))


def _vals(s: SparkSession, d: str, corpus: str) -> DataFrame:
    return mining.values(mining.match(*_mined(s, d, corpus)))


@_add(
    "q59_pieces",
    f"""{_mined_sql('events')}, {META_SQL} SELECT eid, var_idx, line_no, CASE WHEN kind = 'S' AND NOT ({_FITS}) THEN 'O' ELSE kind END AS kind,
CASE WHEN kind = 'S' AND {_FITS} THEN substr(value, length(prefix) + 1, length(value) - length(prefix) - length(suffix)) ELSE value END AS stored FROM v JOIN meta USING (eid, var_idx)""",
)
def _pieces_stored(s: SparkSession, d: str) -> DataFrame:
    vals = _vals(s, d, "events")
    return mining.extract_pieces(vals, mining.column_meta(vals))


@_add("q60_pieces_decoded", f"{_mined_sql('events')} SELECT eid, var_idx, line_no, value FROM v")
def _pieces_decoded(s: SparkSession, d: str) -> DataFrame:
    vals = _vals(s, d, "events")
    meta = mining.column_meta(vals)
    return mining.decode_pieces(mining.extract_pieces(vals, meta), meta)


for _name, _mode, _where in (("q61_values_left", "left", "starts_with(value, '7')"), ("q62_values_right", "right", "ends_with(value, '7')"), ("q63_values_full", "full", "value = '77'")):
    _add(_name, f"{_mined_sql('orders')} SELECT line_no, value FROM v WHERE eid = 0 AND var_idx = 1 AND {_where}")(lambda s, d, m=_mode: catalog.column_values(_store(s, d, "orders"), 0, 1, "77" if m == "full" else "7", m))


@_add("q64_values_in", f"{_mined_sql('orders')} SELECT line_no, value FROM v WHERE eid = 0 AND var_idx = 1 AND value IN ('7', '77', '777')")
def _values_in(s: SparkSession, d: str) -> DataFrame:
    return catalog.column_values_in(_store(s, d, "orders"), 0, 1, ["7", "77", "777"])


@_add("q65_dictionary_search", f"{_mined_sql('orders')} SELECT eid, var_idx, line_no, value FROM v WHERE contains(value, '77')")
def _dictionary_search(s: SparkSession, d: str) -> DataFrame:
    vals = _vals(s, d, "orders")
    words = mining.dictionary(vals)
    return mining.dictionary_search(words, mining.entries(vals, words), "77")


@_add("q66_token", f"SELECT block_id, line_no, line FROM ({ORDERS}) WHERE list_contains({WORDS_SQL}, '77')")
def _token(s: SparkSession, d: str) -> DataFrame:
    return scan(CORPORA["orders"](s, d), "77", "t")


@_add("q67_common_substring", f"SELECT block_id, line_no, line FROM ({EVENTS}) WHERE " + " OR ".join(f"contains(line, '{'SIGNUP user=12'[i:i + 11]}')" for i in range(4)))
def _common(s: SparkSession, d: str) -> DataFrame:
    return CORPORA["events"](s, d).where(Common("SIGNUP user=12", 11).column(F.col("line")))


@_add("q68_search_statistics", f"SELECT 'rows' AS name, count(*) AS n FROM ({ORDERS}) UNION ALL SELECT 'rows_matched', count(*) FROM ({ORDERS}) WHERE contains(line, 'prio=1') AND contains(line, 'cust=7')")
def _statistics(s: SparkSession, d: str) -> DataFrame:
    held = _store(s, d, "orders")
    n = search(held, "prio=1 and cust=7").statistics(held)
    return s.createDataFrame([(k, n[k]) for k in ("rows", "rows_matched")], "name string, n long")


@_add("q69_split_rejoined", f"{_mined_sql('events')} SELECT eid, var_idx, line_no, value FROM v")
def _split_rejoined(s: SparkSession, d: str) -> DataFrame:
    vals = _vals(s, d, "events")
    patterns = mining.split_patterns(vals)
    return mining.joined_values(mining.split_values(vals, patterns), patterns)


@_add("q70_token_search", f"SELECT block_id, line_no, line FROM ({ORDERS}) WHERE list_contains({WORDS_SQL}, '77')")
def _token_search(s: SparkSession, d: str) -> DataFrame:
    return search(_store(s, d, "orders"), "77", kind="t").rows(None)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Q["q10_or_before_and"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
