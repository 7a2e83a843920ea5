"""Frames of figures: places, heights and angles by hand, with null values and missing parts."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import figures

ROWS = [("m1", "a", 0.5, 0.25), ("m1", "b", None, 0.5), ("m2", "a", 1.0, None), ("m2", "c", 0.5, 0.0), (None, "b", 0.9, 0.1)]


def test_frames(spark):
    df = spark.createDataFrame(ROWS, "model string, technique string, accuracy double, fail double")
    got = {(r.model, r.technique, r.part): (r.panel_at, r.bar_at, r.bottom, r.top) for r in figures.bar_panels(df, "model", "technique", "accuracy", "fail").collect()}
    assert len(got) == 10 and got["m1", "a", "fail"] == (2, 0, 0.5, 0.75) and got["m1", "b", "fail"] == (2, 1, 0.0, 0.5) and got["m2", "a", "fail"] == (1, 0, 1.0, 1.0)
    assert got[None, "b", "accuracy"] == (0, 1, 0.0, 0.9) and {v[1] for v in got.values()} == {0, 1, 2}
    corners = [(r["at"], r.technique, r.angle) for r in figures.radar(df.where("model = 'm2'"), "model", "technique", "accuracy").orderBy("at").collect()]
    assert corners == [(0, "a", 0.0), (1, "c", pytest.approx(math.pi)), (2, "a", pytest.approx(2 * math.pi))]
    piles = {(r.model, r.technique): (r.bottom, r.top) for r in figures.stacked(df, "model", "technique", "accuracy").collect()}
    assert piles["m1", "b"] == (0.5, 0.5) and piles["m2", "c"] == (1.0, 1.5)
    grid = {r.model: tuple(r)[1:] for r in figures.heat_map(df, "model", "technique", "accuracy", ["a", "b", "d"]).collect()}
    assert grid == {"m1": (0.5, None, None), "m2": (1.0, None, None), None: (None, 0.9, None)}


def test_trend(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (None, 1.0)], "x double, y double")
    assert [r.fitted for r in figures.trend_line(df, "x", "y").orderBy(F.col("x").asc_nulls_last()).collect()] == [pytest.approx(3), pytest.approx(5), pytest.approx(7), None]
    assert figures.trend_line(df.where("x = 1"), "x", "y").first().fitted is None and figures.trend_line(df.where("false"), "x", "y").count() == 0
