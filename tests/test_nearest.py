"""The nearest-neighbour join against all pairs."""

import math
import random

import pytest

from wakeline.operators import nearest as N


def haversine_nm(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1, math.sqrt(h))) / 1852


@pytest.mark.parametrize("where", ["world", "date line and pole", "far cluster"])
def test_nearest_is_of_all(spark, where):
    rng = random.Random(where)
    if where == "world":
        points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(300)]
        sites = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(150)]
    elif where == "date line and pole":
        points = [(k, rng.choice([-1, 1]) * rng.uniform(80, 90) if k % 2 else rng.uniform(-5, 5), rng.choice([-1, 1]) * rng.uniform(178, 180) if k % 3 else rng.uniform(-180, 180)) for k in range(300)]
        sites = [(k, rng.choice([-1, 1]) * rng.uniform(80, 90) if k % 2 else rng.uniform(-5, 5), rng.choice([-1, 1]) * rng.uniform(175, 180)) for k in range(60)]
    else:  # many sites in one place, on the other side of the world
        points = [(k, rng.uniform(-30, -20), rng.uniform(-60, -50)) for k in range(60)]
        sites = [(k, 24 + rng.random(), 120 + rng.random()) for k in range(2000)]
    sites += [(k + 10_000, a, b) for k, a, b in sites[:20]]  # ties go to the smaller
    df = spark.createDataFrame(points + [(-1, None, 3.0), (-2, 95.0, 3.0), (-3, float("nan"), 3.0)], "id long, latitude double, longitude double")
    got = {r.id: r for r in N.nearest_join(df, spark.createDataFrame(sites, "site long, site_lat double, site_lon double"), "id", "site").collect()}
    assert set(got) == {p[0] for p in points} | {-1, -2, -3} and all(got[k].site is None and got[k].nm is None for k in (-1, -2, -3))
    for k, a, b in points:
        best = min((haversine_nm(a, b, c, d), s) for s, c, d in sites)
        assert got[k].nm == pytest.approx(best[0], abs=1e-6)
        assert got[k].site == best[1] or got[k].nm == pytest.approx(best[0], abs=1e-9)


def test_nearest_without_sites(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id long, latitude double, longitude double")
    assert [tuple(r) for r in N.nearest_join(df, spark.createDataFrame([], "site long, site_lat double, site_lon double"), "id", "site").collect()] == [(1, None, None)]
    assert N.nearest_join(df.limit(0), spark.createDataFrame([(1, 2.0, 3.0)], "site long, site_lat double, site_lon double"), "id", "site").count() == 0


def test_far_sites_are_ruled_out_by_their_cells(spark):
    """20,000 sites in one place, far away: points open a few cells of them."""
    rng = random.Random(3)
    sites = spark.createDataFrame([(k, 24 + 4 * rng.random(), 118 + 4 * rng.random()) for k in range(20_000)], "site long, site_lat double, site_lon double")
    points = spark.createDataFrame([(k, 10.0 + rng.random(), 100.0 + rng.random()) for k in range(100)], "id long, latitude double, longitude double")
    out = N.nearest_join(points, sites, "id", "site")
    plain = points.crossJoin(sites).selectExpr("id", "site", "2 * asin(sqrt(pow(sin(radians(site_lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(site_lat)) * pow(sin(radians(site_lon - longitude) / 2), 2))) as d").groupBy("id").agg({"d": "min"})
    want = {r[0]: r[1] * 6_371_008.8 / 1852 for r in plain.collect()}
    assert all(r.nm == pytest.approx(want[r.id], abs=1e-6) for r in out.collect())
