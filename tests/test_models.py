"""Geodesics, sequential scans, components and the forest, on cases with known answers."""

import numpy as np
import pytest

from wakeline.operators import forest, graph, sequences
from wakeline.scratch import Scratch


def test_vincenty():
    lat1, lon1, lat2, lon2 = (np.array(x, float) for x in ([0, 50.06632, 10, 0], [0, -5.71475, 20, 0], [0, 58.64402, 10, 0.5], [1, -3.07009, 20, 179.7]))
    d = sequences.vincenty_m(lat1, lon1, lat2, lon2)
    assert d[0] == pytest.approx(111319.491, abs=0.01) and d[1] == pytest.approx(969954.1, abs=1) and d[2] == 0 and 19.8e6 < d[3] < 20.1e6


def test_stay_points(spark):
    rows = [(k, "a", t, la, 0.0) for k, (t, la) in enumerate([(0, 0), (600, 0.01), (1200, 0.0), (1800, 1.0), (2400, 1.0), (9000, 1.0), (9600, 1.0), (10_200, 1.001)])]
    df = spark.createDataFrame([(k, v, float(t), float(la), lo) for k, v, t, la, lo in rows], "event_id long, track_id string, t double, latitude double, longitude double")
    got = sorted((r.t0, r.t1, r.n) for r in sequences.stay_points(df, 1.0, 1000, 3600).collect())
    assert got == [(0.0, 1200.0, 3), (9000.0, 10_200.0, 3)]


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("c", "d"), ("d", "a")] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("xy", "x"), **{f"n{i:02d}": "n00" for i in range(41)}}


def test_forest_finds_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    x[:6] += 8
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x)] + [("none", None, 1.0, 1.0)], "id string, a double, b double, c double")
    trees = forest.grow(df, ["a", "b", "c"], 40, 128)
    got = {r.id: r.anomaly for r in forest.score(df, ["a", "b", "c"], trees, 128).collect()}
    assert got["none"] is None
    top = sorted((k for k in got if k != "none"), key=lambda k: -got[k])[:6]
    assert set(top) == {str(i) for i in range(6)}
    assert forest.grow(df.repartition(5), ["a", "b", "c"], 3, 64).count() == forest.grow(df, ["a", "b", "c"], 3, 64).count()
