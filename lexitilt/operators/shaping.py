"""Small result tables: metric rows and the fixed order of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv


def _literal(value: str | int | float) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def small_table(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A table of a few literal rows, whose size the planner knows."""
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(f'`{n}`' for n in names)})")


def as_metrics(one_row: DataFrame) -> DataFrame:
    """One row of counts as (metric, value) rows."""
    return one_row.unpivot([], one_row.columns, "metric", "value")


def group_order(spark: SparkSession, groups: Sequence[str] = tuple(fv.GROUP_ORDER)) -> DataFrame:
    return small_table(spark, ["group_order", "group"], list(enumerate(groups)))


def in_group_order(df: DataFrame, group_col: str = "group",
                   groups: Sequence[str] = tuple(fv.GROUP_ORDER)) -> DataFrame:
    """Every group once in its order, groups without rows included.

    ``df`` is a summary with at most one row per group.
    """
    order = group_order(df.sparkSession, groups).withColumnRenamed("group", group_col)
    return order.join(df, group_col, "left").orderBy("group_order")
