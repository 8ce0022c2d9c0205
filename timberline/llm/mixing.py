"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Targets.  Every source has a weight and a size (the words of its documents).  Together the targets
are ``budget`` times all sizes.  A source is clamped at ``max_epochs`` times its own size, and what
it cannot take goes to the others in proportion to their weights until none is above its clamp.
The fixed point has a closed form: with the sources in order of size / weight, the clamped ones are
a prefix of that order, so two running sums over one row per source find it.

Sampling.  A document is taken ``floor(rate)`` times and once more for a fraction of the documents,
chosen by systematic sampling: documents of a source stand in the order (size to three bits after
the leading one, md5 of seed and id), and those at which ``floor(position * fraction)`` steps are
taken.  So every stretch of similar sizes gives its exact share, and reruns agree.  Positions come
from counts of small cells (source, size class, md5 prefix) plus the position within a cell; no
task ever sees a whole source.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; equal
rows (same id and size) are interchangeable; a source of size 0 has target 0 and its documents are
not taken; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
SEED = "mix-1"
WEIGHTS = (1, 2, 3)
#: Rows of one cell at most, on average over the hottest cells, when the md5 prefix is sized.
CELL_ROWS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS, budget: float = 1.0) -> DataFrame:
    """``sources(source, source_size, weight)`` with a column ``target``; one row per source."""
    cap = (F.col("source_size") * F.lit(max_epochs)).cast("double")
    every = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = (
        sources.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
        .withColumn("level_here", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
        # the first source that the level does not clamp sets the level for it and all after it
        .withColumn("open", F.col("cap") > F.col("level_here") * F.col("weight"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("place", "level_here"))).over(every)["level_here"])
    )
    return x.select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: float = MAX_EPOCHS, budget: float = 1.0, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """Rows ``doc_id, source, size, source_size, target, reps, taken`` for every row of ``docs(doc_id, text, source)``.

    ``weights`` go to the sources by code point order (null last) and repeat.  Columns named in ``carry``
    come along and decide between rows of one id and size.
    """
    n = docs.count()
    digits = 1
    while 128 * 16**digits * CELL_ROWS < n and digits < 8:
        digits += 1
    sized = docs.select("doc_id", F.col("source"), words(F.col("text")).alias("size"), *carry)
    sized = (
        sized.withColumn("skey", F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce("source", F.lit(""))))
        .withColumn("bits", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))
        .withColumn("top", F.substring(F.bin("size"), 1, 4))
        .withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
        .withColumn("hp", F.substring("h", 1, digits))
    )
    cell = ["skey", "bits", "top", "hp"]
    cells = sized.groupBy(*cell).agg(F.count("*").alias("cell_n"), F.sum("size").alias("cell_size"))
    sources = cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size"))
    ranked = sources.withColumn("source", F.col("skey")).withColumn("r", F.row_number().over(Window.orderBy("skey")))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("r") - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = water_fill(ranked.select("source", "source_size", weight.alias("weight")), max_epochs, budget).select(F.col("source").alias("skey"), "source_size", "target")
    before = Window.partitionBy("skey").orderBy("bits", "top", "hp").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("offset", F.coalesce(F.sum("cell_n").over(before), F.lit(0))).join(filled, "skey").select(*cell, "offset", "source_size", "target")
    at = Window.partitionBy(*cell).orderBy("h", "size", *carry)
    x = sized.join(placed, cell).withColumn("pos", F.col("offset") + F.row_number().over(at) - 1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    x = x.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    extra = F.floor((F.col("pos") + 1) * F.col("part") + 0.5) - F.floor(F.col("pos") * F.col("part") + 0.5)
    x = x.withColumn("reps", (F.col("whole") + extra).cast("long"))
    return x.select("doc_id", "source", "size", "source_size", "target", "reps", (F.col("size") * F.col("reps")).alias("taken"), *carry)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all their columns, each as often as it is taken.

    Rows are told apart by all their columns (two 64-bit hashes), so rows of one id or none are each
    taken as often as ``mix`` says; equal rows share what they are taken together.
    """
    names, tags = docs.columns, ["__t1", "__t2"]
    values = [x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    tagged = docs.withColumns({t: F.xxhash64(F.lit(i), *values) for i, t in enumerate(tags)})
    key = mix(tagged, carry=tags, **options).groupBy(*tags).agg(F.sum("reps").alias("__reps"), F.count("*").alias("__n")).where("__reps > 0")
    # the join leaves the rows dealt and sorted by the tags, as the window wants them
    x = tagged.join(key, tags).withColumn("__i", F.row_number().over(Window.partitionBy(*tags).orderBy(*tags)))
    times = F.expr("cast(__reps div __n + if(__i <= __reps % __n, 1, 0) as int)")
    return x.withColumn("__times", times).where("__times > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in names])


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, (source_size * 3)::DOUBLE AS cap FROM src),
lev AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps_before,
  (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights_left,
  row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM ranked),
opened AS (SELECT *, (total - caps_before) / weights_left AS here FROM lev),
firsts AS (SELECT *, min(CASE WHEN cap > here * weight THEN place END) OVER () AS k FROM opened),
levelled AS (SELECT *, max(CASE WHEN place = k THEN here END) OVER () AS level FROM firsts),
filled AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM levelled),
pos AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END, substr(bin(size), 1, 4), h, size) - 1 AS pos FROM sized),
rated AS (SELECT p.*, f.source_size, f.target, CASE WHEN f.source_size > 0 THEN f.target / f.source_size ELSE 0.0 END AS rate
  FROM pos p JOIN filled f ON p.source IS NOT DISTINCT FROM f.source),
taken AS (SELECT *, (floor(rate) + floor((pos + 1) * (rate - floor(rate)) + 0.5) - floor(pos * (rate - floor(rate)) + 0.5))::BIGINT AS reps FROM rated)
SELECT doc_id, source, size, source_size, target, reps, size * reps AS taken FROM taken
"""
