"""What a store holds: templates, their columns, the values of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mining
from ..sources.store import Store


def template_list(store: Store) -> DataFrame:
    return store.templates.select("eid", "n_rows").orderBy(F.desc("n_rows"), "eid")


def template_body(store: Store, eid: int) -> DataFrame:
    return mining.template_text(store.templates.where(F.col("eid") == eid)).select("eid", "template")


def column_list(store: Store, eid: int) -> DataFrame:
    return store.columns.where(F.col("eid") == eid).orderBy("var_idx")


def column_values(store: Store, eid: int, var_idx: int, containing: str | None = None, mode: str = "any") -> DataFrame:
    """``line_no, value`` of one variable, read alone; ``mode`` says where ``containing`` stands in a value (full, left, right, any)."""
    x = store.values(eid, var_idx)
    return x if containing is None else x.where(mining.aligned(F.col("value"), containing, mode))


def column_values_in(store: Store, eid: int, var_idx: int, wanted: list[str]) -> DataFrame:
    return store.values(eid, var_idx).where(F.col("value").isin(wanted))
