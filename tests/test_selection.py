"""Exact medians of big groups against Spark's own and Python's."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from textloom.operators.selection import medians


def told(df):
    return {(r["g"], r["h"]): (r["median"], r["n"]) for r in df.collect()}


@pytest.mark.parametrize("bounds", [{"big": 5, "walked": 3, "cells": 4}, {"big": 50, "walked": 20}, {"big": 1_000_000}])
def test_any_shape_of_values(spark, bounds):
    rows = [("even", None, float(i * i)) for i in range(100)] + [("odd", None, 10.0 ** (i % 11 - 5)) for i in range(101)] + [("ties", 1, 7.0)] * 60 + [("ties", 1, 8.0)] * 60
    rows += [("mostly", 2, 1.0)] * 150 + [("mostly", 2, float(i)) for i in range(40)] + [(None, 3, -0.5 * i) for i in range(77)] + [("few", 4, 2.0), ("few", 4, 3.0), ("few", 4, None), ("none", 5, None)]
    want = {}
    for g, h, v in rows:
        if v is not None:
            want.setdefault((g, h), []).append(v)
    got = told(medians(spark.createDataFrame(rows, "g string, h int, x double").repartition(5), ["g", "h"], "x", **bounds))
    assert got == {k: (statistics.median(v), len(v)) for k, v in want.items()}


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([("a", 1, v) for v in (1.0, 2.0, math.nan, math.nan, math.nan)] * 9, "g string, h int, x double")
    assert math.isnan(told(medians(df, ["g", "h"], "x", big=5, walked=1, cells=4))["a", 1][0])


def test_millions_in_one_group(spark):
    df = spark.range(4_000_000).select(F.lit("a").alias("g"), F.lit(1).alias("h"), (F.pmod(F.xxhash64("id"), F.lit(3_000_017)) / 7).alias("x"))
    want = df.agg(F.median("x")).first()[0]
    assert told(medians(df, ["g", "h"], "x", big=100_000, walked=5_000))["a", 1] == (want, 4_000_000)


def test_outliers_do_not_depend_on_the_way(spark, sf_dir):
    from tests.compare import rows
    from textloom.operators import records as R

    r = R.order_records(spark, sf_dir)
    assert rows(R.outliers(r, big=3).toPandas()) == rows(R.outliers(r).toPandas())
