"""Row sets: algebra on the results of searches, as DataFrames of ``block_id, line_no``."""

from __future__ import annotations

from pyspark.sql import DataFrame

KEY = ["block_id", "line_no"]


def row_set(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return row_set(a).union(row_set(b)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return row_set(a).join(row_set(b), KEY, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return row_set(a).join(row_set(b), KEY, "left_anti")


def complement(every: DataFrame, a: DataFrame) -> DataFrame:
    return difference(every, a)
