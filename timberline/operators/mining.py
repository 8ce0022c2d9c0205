"""Templates and columns: the relational miner, matching, column statistics, dictionaries.

A template is a skeleton (a line with its words blanked out) and, at each word position, either a
constant word or a variable slot.  Mining needs the least and greatest word at a position only, so
the one shuffle carries an aggregate per (skeleton, position), combined before it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CLASSES, class_mask, is_delimiter, longest_common_substring, shape, skeleton, words

#: Fewer values than this make a raw column; a distinct rate below that a dictionary.
RAW_BELOW = 100
DICTIONARY_RATE = 0.5
SAMPLE_EVERY = 100
TOP_SHAPES = 3
#: Lines of a stretch whose new values are numbered together.
CELL_LINES = 1 << 20


def sample(lines: DataFrame, every: int = SAMPLE_EVERY) -> DataFrame:
    return lines.where(F.pmod(F.col("line_no"), F.lit(every)) == 1)


def reservoir(lines: DataFrame, n: int, seed: str = "r1") -> DataFrame:
    """``n`` lines, each as likely as any other: those of the smallest md5 of seed and place, so reruns agree."""
    h = F.md5(F.concat_ws(":", F.lit(seed), "block_id", "line_no").cast("binary"))
    return lines.withColumn("h", h).orderBy("h", "block_id", "line_no").limit(n).drop("h")


def sample_ratio(lines: DataFrame, every: int = SAMPLE_EVERY) -> DataFrame:
    """``skeleton, n_rows, n_sampled, ratio``: how far the sample stands for the lines of each skeleton."""
    taken = F.sum(F.when(F.pmod(F.col("line_no"), F.lit(every)) == 1, 1).otherwise(0))
    x = lines.groupBy(skeleton(F.col("line")).alias("skeleton")).agg(F.count("*").alias("n_rows"), taken.alias("n_sampled"))
    return x.withColumn("ratio", F.col("n_sampled") / F.col("n_rows"))


def mine(lines: DataFrame, min_rows: int = 1) -> DataFrame:
    """``skeleton, n_rows, slots array<string>``: the constant word of each position, null at a variable slot."""
    # the skeleton below the explosion, once for each line; above it, it would be made once for each word
    x = lines.select(skeleton(F.col("line")).alias("skeleton"), words(F.col("line")).alias("ws")).select("skeleton", F.posexplode("ws").alias("pos", "w"))
    # words as hashes, which a hash aggregate can hold; a sort of all words by skeleton is what texts would cost
    h = F.xxhash64("w")
    at = x.groupBy("skeleton", "pos").agg(F.count("*").alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi"))
    slot = F.struct("pos", (F.col("lo") == F.col("hi")).alias("constant"))
    t = at.groupBy("skeleton").agg(F.max("n").alias("n_rows"), F.array_sort(F.collect_list(slot)).alias("s")).where(F.col("n_rows") >= min_rows)
    one = lines.groupBy(skeleton(F.col("line")).alias("skeleton")).agg(F.first("line").alias("line"))
    slots = F.zip_with("s", words(F.col("line")), lambda s, w: F.when(s["constant"], w))
    return t.join(one, "skeleton").select("skeleton", "n_rows", slots.alias("slots"))


def number(templates: DataFrame) -> DataFrame:
    """``eid`` by rows, most first; one row for each template."""
    return templates.withColumn("eid", F.row_number().over(Window.orderBy(F.desc("n_rows"), "skeleton")) - 1)


def _written(slots: str = "slots") -> Column:
    """The skeleton's gaps and the constant words, in order; a line break, which no line holds, at each slot."""
    return F.array_join(F.transform(F.split("skeleton", "W"), lambda g, i: F.concat(g, F.when(i < F.size(slots), F.coalesce(F.get(slots, i), F.lit("\n"))).otherwise(F.lit("")))), "")


def with_pieces(templates: DataFrame) -> DataFrame:
    """``pieces array<string>``: the constant text before, between and after the slots."""
    return templates.withColumn("pieces", F.split(_written(), "\n"))


def template_text(templates: DataFrame) -> DataFrame:
    """The template written out, slots as ``<V0>``, ``<V1>``, ..."""
    t = with_pieces(templates)
    last = F.size("pieces") - 1
    text = F.array_join(F.transform("pieces", lambda p, i: F.concat(p, F.when(i < last, F.concat(F.lit("<V"), i.cast("string"), F.lit(">"))).otherwise(F.lit("")))), "")
    return t.withColumn("template", text).drop("pieces")


def match(lines: DataFrame, templates: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines with ``eid`` and ``vars``; a line that fits no template has eid -1 and no variables.  ``keep`` names template columns that come along."""
    free = F.filter(F.transform("slots", lambda c, i: F.when(c.isNull(), i)), lambda i: i.isNotNull())
    fixed = F.filter(F.transform("slots", lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda z: z["c"].isNotNull())
    t = templates.select("eid", F.col("skeleton").alias("sk"), free.alias("free"), fixed.alias("fixed"), *keep)
    x = lines.withColumn("sk", skeleton(F.col("line"))).withColumn("ws", words(F.col("line"))).join(t, "sk", "left")
    fits = F.col("eid").isNotNull() & F.forall("fixed", lambda z: F.get("ws", z["i"]) == z["c"])
    slot = F.transform("free", lambda i: F.get("ws", i))
    return x.select(*lines.columns, F.when(fits, F.col("eid")).otherwise(-1).alias("eid"), F.when(fits, slot).alias("vars"), *keep)


def filled(pieces: Column, vars_: Column) -> Column:
    """The line of a template's pieces and a row's variables."""
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(vars_, i), F.lit("")))), "")


def rebuild(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Lines made again from template and variables; outliers keep their own line.  Rows that carry ``pieces`` need no join."""
    x = rows if "pieces" in rows.columns else rows.join(with_pieces(templates).select("eid", "pieces"), "eid", "left")
    line = F.when(F.col("eid") >= 0, filled(F.col("pieces"), F.col("vars"))).otherwise(F.col("line"))
    return x.select(*[c for c in rows.columns if c != "pieces"], line.alias("rebuilt"))


def values(rows: DataFrame) -> DataFrame:
    """One row for each variable of each line: ``eid, var_idx, line_no, value``."""
    return rows.where("eid >= 0").select("eid", "line_no", F.posexplode("vars").alias("var_idx", "value"))


def distinct_values(vals: DataFrame) -> DataFrame:
    return vals.groupBy("eid", "var_idx", "value").agg(F.count("*").alias("n"))


def column_meta(vals: DataFrame) -> DataFrame:
    """``eid, var_idx, kind, n_values, n_distinct, char_mask, min_len, max_len, prefix, suffix, pattern``."""
    return meta_of(distinct_values(vals))


def meta_of(each: DataFrame) -> DataFrame:
    x = each.groupBy("eid", "var_idx").agg(
        F.sum("n").alias("n_values"), F.count("*").alias("n_distinct"), F.bit_or(class_mask(F.col("value"))).alias("char_mask"),
        F.min(F.length("value")).alias("min_len"), F.max(F.length("value")).alias("max_len"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min(F.reverse("value")).alias("rlo"), F.max(F.reverse("value")).alias("rhi"),
    )
    kind = F.when(F.col("n_values") < RAW_BELOW, "V").when(F.col("n_distinct") < F.col("n_values") * DICTIONARY_RATE, "D").otherwise("S")

    def common(a: str, b: str):
        # the values between least and greatest share what those two share at the front
        short = f"least(length({a}), length({b}))"
        differs = f"array_position(transform(sequence(1, greatest(1, {short})), i -> substring({a}, i, 1) = substring({b}, i, 1)), false)"
        return F.expr(f"substring({a}, 1, if({differs} = 0, {short}, {differs} - 1))")

    x = x.withColumn("prefix", common("lo", "hi")).withColumn("suffix", F.reverse(common("rlo", "rhi")))
    whole = F.col("lo") == F.col("hi")
    x = x.withColumn("suffix", F.when(~whole & (F.length("prefix") + F.length("suffix") <= F.col("min_len")), F.col("suffix")).otherwise(F.lit("")))
    pattern = F.when(whole, F.col("lo")).otherwise(F.concat("prefix", F.lit("<*>"), "suffix"))
    return x.select("eid", "var_idx", kind.alias("kind"), "n_values", "n_distinct", "char_mask", "min_len", "max_len", "prefix", "suffix", pattern.alias("pattern"))


def between(value: Column, prefix: Column, suffix: Column) -> Column:
    """What a value has between its column's prefix and suffix; null where it does not fit them."""
    fits = value.startswith(prefix) & value.endswith(suffix) & (F.length(value) >= F.length(prefix) + F.length(suffix))
    return F.when(fits, F.substring(value, F.length(prefix) + 1, F.length(value) - F.length(prefix) - F.length(suffix)))


def extract_pieces(vals: DataFrame, meta: DataFrame) -> DataFrame:
    """``eid, var_idx, line_no, kind, stored``: the piece of a value of a pattern column (S), the value itself of others; values that don't fit are whole, with kind O."""
    x = vals.join(meta.select("eid", "var_idx", "kind", "prefix", "suffix"), ["eid", "var_idx"])
    piece = between(F.col("value"), F.col("prefix"), F.col("suffix"))
    kind = F.when((F.col("kind") == "S") & piece.isNull(), "O").otherwise(F.col("kind"))
    return x.select("eid", "var_idx", "line_no", kind.alias("kind"), F.when(kind == "S", piece).otherwise(F.col("value")).alias("stored"))


def decode_pieces(stored: DataFrame, meta: DataFrame) -> DataFrame:
    """The values of ``extract_pieces`` again, by kind."""
    x = stored.join(meta.select("eid", "var_idx", "prefix", "suffix"), ["eid", "var_idx"])
    return x.select("eid", "var_idx", "line_no", F.when(F.col("kind") == "S", F.concat("prefix", "stored", "suffix")).otherwise(F.col("stored")).alias("value"))


def aligned(value: Column, needle: str, mode: str = "any") -> Column:
    """``full``, ``left`` (a prefix), ``right`` (a suffix) or ``any``."""
    return {"full": value == needle, "left": value.startswith(needle), "right": value.endswith(needle), "any": value.contains(needle)}[mode]


def dictionary_search(words_: DataFrame, ids: DataFrame, needle: str, mode: str = "any") -> DataFrame:
    """Rows of ``entries`` whose value fits: the needle is looked up among the distinct values, rows are met by id."""
    hit = words_.where(aligned(F.col("value"), needle, mode)).select("eid", "var_idx", "id", "value")
    return ids.join(hit, ["eid", "var_idx", "id"]).select("eid", "var_idx", "line_no", "value")


def dictionary(vals: DataFrame) -> DataFrame:
    """``eid, var_idx, id, value, shape``: distinct values, the commonest shapes first, then by first line."""
    each = vals.groupBy("eid", "var_idx", "value").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line")).withColumn("shape", shape(F.col("value")))
    shapes = each.groupBy("eid", "var_idx", "shape").agg(F.count("*").alias("c"))
    ranked = shapes.withColumn("r", F.least(F.row_number().over(Window.partitionBy("eid", "var_idx").orderBy(F.desc("c"), "shape")), F.lit(TOP_SHAPES + 1)))
    x = each.join(ranked, ["eid", "var_idx", "shape"]).withColumn("cell", F.expr(f"first_line div {CELL_LINES}"))
    # places by counts of cells and within a cell, so no column's values stand in one task
    cells = x.groupBy("eid", "var_idx", "r", "cell").agg(F.count("*").alias("c"))
    before = Window.partitionBy("eid", "var_idx").orderBy("r", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("eid", "var_idx", "r", "cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    at = Window.partitionBy("eid", "var_idx", "r", "cell").orderBy("first_line", "value")
    x = x.join(cells, ["eid", "var_idx", "r", "cell"])
    return x.select("eid", "var_idx", (F.col("offset") + F.row_number().over(at) - 1).cast("int").alias("id"), "value", "shape")


def entries(vals: DataFrame, words_: DataFrame) -> DataFrame:
    return vals.join(words_.select("eid", "var_idx", "value", "id"), ["eid", "var_idx", "value"]).select("eid", "var_idx", "line_no", "id")


def value_outliers(vals: DataFrame, pattern: str) -> DataFrame:
    return vals.where(~F.col("value").rlike(pattern))


def similarity(a: list[str], b: list[str | None]) -> float:
    """Equal positions over all; a slot (None) counts as equal."""
    return sum(y is None or x == y for x, y in zip(a, b, strict=True)) / max(1, len(a))


def likeness(a: Column, b: Column) -> Column:
    """The same on two arrays of tokens, delimiters included: 0 if their numbers or a delimiter differ."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    wrong = (F.size(a) != F.size(b)) | F.exists(both, lambda z: (is_delimiter(z["a"]) | is_delimiter(z["b"])) & ~z["a"].eqNullSafe(z["b"]))
    return F.when(wrong, 0.0).otherwise(F.size(F.filter(both, lambda z: z["a"] == z["b"])) / F.greatest(F.size(a), F.lit(1)))


def greedy_mine(lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Templates in order of appearance in each block: a line joins the first one of its skeleton that is like it.

    Depends on order by nature; a block is a file's worth of lines, so a group is of bounded size.
    """

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..functions.text import WORD

        pool: dict[str, list[list]] = {}
        for line in pdf.sort_values("line_no")["line"]:
            sk, ws = re.sub(WORD, "W", line), re.findall(WORD, line)
            for t in pool.setdefault(sk, []):
                if similarity(ws, t[0]) > threshold:
                    t[0] = [x if x == y else None for x, y in zip(ws, t[0], strict=True)]
                    t[1] += 1
                    break
            else:
                pool[sk].append([ws, 1])
        rows = [(pdf["block_id"].iloc[0], sk, n, ["<*>" if w is None else w for w in t]) for sk, ts in pool.items() for t, n in ts]
        return pd.DataFrame(rows, columns=["block_id", "skeleton", "n_rows", "slots"])

    return lines.select("block_id", "line_no", "line").groupBy("block_id").applyInPandas(block, "block_id long, skeleton string, n_rows long, slots array<string>")


def split_pattern(vals: list[str], share: float = 0.9, depth: int = 8) -> str:
    """A pattern for most of the values: constants, symbols and common substrings found recursively.

    Leaves are ``<F,mask,length>`` for pieces of one length, else ``<V,mask,longest>``.
    """
    from ..functions.text import python_mask

    def leaf(xs: list[str]) -> str:
        mask = 0
        for x in xs:
            mask |= python_mask(x)
        lengths = Counter(map(len, xs))
        n, c = lengths.most_common(1)[0]
        return f"<F,{mask},{n}>" if c > share * len(xs) else f"<V,{mask},{max(lengths)}>"

    def walk(xs: list[str], left: int) -> str:
        xs = [x for x in xs if x]
        if not xs:
            return ""
        v, c = Counter(xs).most_common(1)[0]
        if c > share * len(xs):
            return v
        # three pivots: the first, the middle and the last value
        pivots = [xs[0], xs[len(xs) // 2], xs[-1]]
        if left:
            for pivot in dict.fromkeys(pivots):
                for ch in sorted({ch for ch in pivot if not ch.isalnum()}, key=pivot.index):
                    have = [x for x in xs if ch in x]
                    if len(have) > share * len(xs):
                        return walk([x.split(ch, 1)[0] for x in have], left - 1) + ch + walk([x.split(ch, 1)[1] for x in have], left - 1)
            subs = [longest_common_substring(a, b) for a, b in ((pivots[0], pivots[1]), (pivots[1], pivots[2]), (pivots[0], pivots[2]))] if len(xs) > 1 else []
            for sub in sorted({x for x in subs if len(x) >= 3}, key=len, reverse=True):
                have = [x for x in xs if sub in x]
                if len(have) <= share * len(xs):
                    continue
                return walk([x.split(sub, 1)[0] for x in have], left - 1) + sub + walk([x.split(sub, 1)[1] for x in have], left - 1)
        return leaf(xs)

    return walk(list(vals), depth)


def pattern_regex(pattern: str) -> str:
    """A split pattern as an anchored regular expression with a group for each piece."""
    out = []
    for part in re.split(r"(<[FV],[0-9]+,[0-9]+>)", pattern):
        m = re.fullmatch(r"<([FV]),([0-9]+),([0-9]+)>", part)
        if not m:
            out.append(re.escape(part))
            continue
        signs = "".join(c.strip("[]") for c, bit in CLASSES[:5] if int(m[2]) & bit)
        kind = f"[{signs}]" if not int(m[2]) & 32 else f"(?:[{signs}]|[^0-9A-Za-z])" if signs else "[^0-9A-Za-z]"
        out.append(f"({kind}{{{m[3]}}})" if m[1] == "F" else f"({kind}{{0,{m[3]}}})")
    return "^" + "".join(out) + "$"


def compiled(patterns: DataFrame) -> DataFrame:
    """``eid, var_idx, regex, constants, groups`` of split patterns; one row a column."""

    def column(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            constants = [re.split(r"<[FV],[0-9]+,[0-9]+>", p) for p in b["pattern"]]
            yield pd.DataFrame({"eid": b["eid"], "var_idx": b["var_idx"], "regex": [pattern_regex(p) for p in b["pattern"]], "constants": constants, "groups": [len(c) - 1 for c in constants]})

    return patterns.select("eid", "var_idx", "pattern").mapInPandas(column, "eid int, var_idx int, regex string, constants array<string>, groups int")


def split_values(vals: DataFrame, patterns: DataFrame) -> DataFrame:
    """``eid, var_idx, line_no, pieces, value``: pieces of the values that fit their column's split pattern, the value itself of the others (pieces null)."""
    x = vals.join(compiled(patterns).drop("constants"), ["eid", "var_idx"])
    got = F.expr("if(groups = 0, cast(array() as array<string>), transform(sequence(1, groups), g -> regexp_extract(value, regex, g)))")
    x = x.withColumn("pieces", F.when(F.expr("value rlike regex"), got))
    return x.select("eid", "var_idx", "line_no", "pieces", F.when(F.col("pieces").isNull(), F.col("value")).alias("value"))


def joined_values(split: DataFrame, patterns: DataFrame) -> DataFrame:
    """The values of ``split_values`` again: constants and pieces in order, outliers as they are."""
    x = split.join(compiled(patterns).select("eid", "var_idx", "constants"), ["eid", "var_idx"])
    return x.select("eid", "var_idx", "line_no", F.coalesce("value", filled(F.col("constants"), F.col("pieces"))).alias("value"))


def split_patterns(vals: DataFrame, least: int = 1000, rate: float = 0.0001) -> DataFrame:
    """``eid, var_idx, pattern`` from a sample of each column: ``max(least, rate * n)`` of its n values, those of the smallest md5 of line_no."""
    n = vals.groupBy("eid", "var_idx").agg(F.count("*").alias("n"))
    some = vals.join(n, ["eid", "var_idx"]).withColumn("h", F.md5(F.col("line_no").cast("string").cast("binary")))
    # about as many as wanted by the hash first, so that no task gathers a column
    wanted = F.greatest(F.lit(least), (F.col("n") * rate).cast("int"))
    near = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("n") <= wanted * (1.5 * (1 << 32)) + (1 << 36)
    first = some.where(near).withColumn("r", F.row_number().over(Window.partitionBy("eid", "var_idx").orderBy("h", "value"))).where(F.col("r") <= wanted)

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"eid": [pdf["eid"].iloc[0]], "var_idx": [pdf["var_idx"].iloc[0]], "pattern": [split_pattern(pdf.sort_values("r")["value"].tolist())]})

    return first.select("eid", "var_idx", "r", "value").groupBy("eid", "var_idx").applyInPandas(column, "eid int, var_idx int, pattern string")
