"""The plug-in surface, polygons, hulls and the supervised part."""

import graphlib

import pytest
from pyspark.sql import functions as F

from fluxtrail.operators import classify
from fluxtrail.plans import pipeline


def test_sequence_stops_and_taps(spark):
    pipeline.stage("t_double")(lambda df, by=2: df.withColumn("v", F.col("v") * by).withColumn("done", F.col("v") > 5))
    plan = pipeline.Sequence.parse("t_double # first\nunknown\n\nt_double\n", parameters={"t_double": {"by": 3}}, stop="done")
    assert [r.v for r in plan.run(spark.createDataFrame([(0,), (1,), (2,)], "v long")).collect()] == [0]
    assert sorted(r.v for r in plan.taps["t_double"].collect()) == [0]


def test_parameters_and_attributes(spark):
    assert pipeline.parameter({"a": {"x": 1, "b": {"y": 2}}, "c": {"y": 3}}, "y") == 2
    assert pipeline.parameter({}, "y", 9) == 9
    pipeline.attribute("t_speed", lambda: F.col("v") * 2, lambda: F.lit(0.5))
    assert tuple(pipeline.with_attributes(spark.createDataFrame([(3,)], "v long"), ["t_speed", "none"]).first()) == (3, 6, 0.5)


def test_model_order_and_cycles(spark):
    df = spark.createDataFrame([(1,)], "a long")
    models = [
        pipeline.Model("c", lambda: {"c": F.col("b") + 1}, ("b",), lambda: {"a": F.col("c")}),
        pipeline.Model("b", lambda: {"b": F.col("a") + 1}),
        pipeline.Model("d", lambda: {"d": F.col("zz")}, ("missing",)),
    ]
    assert pipeline.applied(df, models).first().asDict() == {"a": 3, "b": 2, "c": 3}
    with pytest.raises(graphlib.CycleError):
        pipeline.applied(df, [pipeline.Model("x", dict, ("y",)), pipeline.Model("y", dict, ("x",))])


SHAPE = "array<struct<x double, y double>>"
SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def test_polygon_clip(spark):
    moved = [(x + 2, y + 1) for x, y in SQUARE]
    away = [(x + 50, y) for x, y in SQUARE]
    rows = spark.createDataFrame([(1, SQUARE, moved), (2, SQUARE, away), (3, SQUARE, SQUARE), (4, None, SQUARE), (5, SQUARE, SQUARE[:2])], f"id long, p {SHAPE}, q {SHAPE}")
    assert {r.id: r.area for r in classify.clipped(rows).collect()} == {1: 6.0, 2: 0.0, 3: 16.0, 4: 0.0, 5: 0.0}


def test_hull(spark):
    rows = spark.createDataFrame([(1, SQUARE + [(1.0, 1.0), (2.0, 3.0)]), (2, []), (3, None)], f"id long, points {SHAPE}")
    found = {r.id: r for r in classify.hulls(rows).collect()}
    assert len(found[1].hull) == 4 and found[1].area == 16.0 and found[2].hull == [] and found[3].axis is None


def test_supervised_part(spark):
    rows = [(i, [float(i % 3 * 10 + j + (i * j % 5) / 10) for j in range(4)], float(i % 3) * 5, 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y double, weight double")
    groups = classify.clusters(classify.principal(df)).groupBy("cluster").agg(F.countDistinct(F.col("id") % 3).alias("kinds")).collect()
    assert sorted(r.kinds for r in groups) == [1, 1, 1]
    found = classify.regressed(df).collect()
    assert len(found) == 90 and sum(abs(r.y - r.guess) for r in found) / 90 < 1.0
