"""Frames behind the figures (S27): what a bar, radar, stack, heat map or scatter draws, as a table with
every coordinate worked out; drawing them is left to a plotting tool.

Inputs are tables of metrics, a row a run or less; the windows here are over those rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col


def bar_panels(metrics: DataFrame, panel: str, bar: str, value: str, on_top: str | None = None) -> DataFrame:
    """``metrics`` with panel_at, bar_at (from 0), bottom and top: one panel a ``panel``, best mean value first;
    one bar a ``bar``, in order of its name, of height ``value``; with ``on_top`` a second row a bar, part = on_top,
    that stands on the first.  Null values are bars of no height."""
    mean = metrics.groupBy(panel).agg(F.avg(value).alias("_mean"))
    panels = mean.select(F.col(panel).alias("_panel"), (F.row_number().over(Window.orderBy(F.col("_mean").desc_nulls_last(), F.col(panel))) - 1).alias("panel_at"))
    bars = metrics.select(F.col(bar).alias("_bar")).distinct().select("_bar", (F.row_number().over(Window.orderBy("_bar")) - 1).alias("bar_at"))
    rows = metrics.join(panels, F.col(panel).eqNullSafe(F.col("_panel"))).join(bars, F.col(bar).eqNullSafe(F.col("_bar")))
    high = F.coalesce(F.col(value), F.lit(0.0)).cast("double")
    parts = [F.struct(F.lit(value).alias("part"), F.lit(0.0).alias("bottom"), high.alias("top"))]
    if on_top:
        parts.append(F.struct(F.lit(on_top).alias("part"), high.alias("bottom"), (high + F.coalesce(F.col(on_top), F.lit(0.0))).alias("top")))
    return rows.select(panel, bar, "panel_at", "bar_at", F.inline(F.array(*parts)))


def radar(values: DataFrame, panel: str, axis: str, value: str) -> DataFrame:
    """(panel, axis, at, angle, value): the corners of a closed line a panel: axes in order of their names at
    equal angles, and the first once more at 2 pi."""
    n = F.count("*").over(Window.partitionBy(panel))
    at = F.row_number().over(Window.partitionBy(panel).orderBy(axis)) - 1
    rows = values.select(panel, axis, at.alias("at"), n.alias("_n"), F.col(value).alias("value"))
    last = rows.where("at = 0").withColumn("at", F.col("_n").cast("int"))
    return rows.unionByName(last).select(panel, axis, "at", (F.lit(2 * math.pi) * F.col("at") / F.col("_n")).alias("angle"), "value")


def stacked(values: DataFrame, bar: str, part: str, value: str) -> DataFrame:
    """``values`` with bottom and top: the parts of a bar in order, each on the ones before; nulls have no height."""
    own = F.coalesce(F.col(value), F.lit(0.0)).cast("double")
    top = F.sum(own).over(Window.partitionBy(bar).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn("top", top).withColumn("bottom", F.col("top") - own)


def heat_map(values: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row a ``row``, one column a name of ``columns``: the mean value there, null where there is none."""
    return values.groupBy(row).pivot(column, columns).agg(F.avg(value))


def trend_line(points: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, fitted): the points of a scatter and the least-squares line over them; no line for one place."""
    line = points.where(col(x).isNotNull() & col(y).isNotNull()).agg(F.regr_slope(F.col(y), F.col(x)).alias("_a"), F.regr_intercept(F.col(y), F.col(x)).alias("_b"))
    fitted: Column = F.col("_a") * F.col(x) + F.col("_b")
    return points.join(F.broadcast(line)).withColumn("fitted", fitted).drop("_a", "_b")  # a line is one row
