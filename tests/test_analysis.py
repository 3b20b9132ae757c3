"""Loitering by hand-made tracks, gatherings, and alerts from events."""

import math

import pytest
from pyspark.sql import functions as F

from wakeline.operators import analysis as A
from wakeline.operators import detect as D

SCHEMA = "track_id string, event_id long, t double, latitude double, longitude double, sog double, status int, vessel_type int, cog double, heading double"
ZONES = [(1, "port", 24.0, 120.0), (2, "cable", 24.0, 121.0), (3, "fishing_ground", 26.0, 120.0)]


def track(name, event, lat, lon, *, kind=80, hours=5.0, kn=1.0, status=0, transit=60, t0=1_705_300_000.0):
    """Under way for a while, then a stay of some hours, a report each ten minutes."""
    rows = [(name, event + k, t0 + 600.0 * k, lat - 3 + 0.05 * k, lon, 12.0, 0, kind, 1.0, 1.0) for k in range(transit)]
    rows += [(name, event + transit + k, t0 + 600.0 * (transit + k), lat + 0.002 * (k % 3), lon, kn, status, kind, 1.0, 1.0) for k in range(int(hours * 6) + 1)]
    return rows


@pytest.fixture(scope="module")
def world(spark):
    z = spark.createDataFrame(ZONES, "zone_id long, kind string, lat_c double, lon_c double").withColumn("half_deg", F.lit(0.15))
    rows = []
    places = {
        "open": (22.0, 118.0, {}), "cable": (24.3, 121.0, {}), "inside": (24.0, 121.0, {}), "port": (24.0, 120.0, {}), "moored": (22.5, 118.5, {"status": 5}), "fast": (22.5, 119.5, {"kn": 9.0}),
        "fisher": (26.0, 120.0, {"kind": 30}), "boat": (22.0, 119.0, {"kind": 37}), "own": (21.0, 117.0, {}), "short": (22.0, 120.5, {"hours": 1.0}), "always": (21.5, 121.5, {"transit": 0}),
    }
    for k, (name, (la, lo, options)) in enumerate(places.items()):
        rows += track(name, 1000 * k, la, lo, **options)
    history = spark.createDataFrame(track("own", 90_000, 21.0, 117.0, t0=1_704_300_000.0), SCHEMA)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ship_type", F.when(F.col("vessel_type") == 30, "fishing").when(F.col("vessel_type") == 37, "pleasure").otherwise("tanker"))
    learned = A.learned_context(history)
    return df, z, learned


def test_loitering_in_context(world):
    df, z, learned = world
    cfg = A.LoiterConfig()
    got = {r.track_id: r for r in A.loitering(A.in_context(df, z, learned), z, learned, cfg).collect()}
    assert set(got) == {"open", "cable", "boat", "own"}
    dwell = 40 + 30 * min(1.0, (5 * 3600 - 5400) / 10_800)
    capped = lambda x: pytest.approx(min(100.0, x))
    assert got["open"].severity == pytest.approx(dwell + 10 + 5) and got["boat"].severity == pytest.approx(dwell + 10 - 20)
    assert got["cable"].severity == capped(dwell + 10 + 18 + 5) and got["cable"].zone_nm < 10
    assert got["own"].severity == pytest.approx(dwell + 10 + 5 - 28) and got["own"].own_spot
    assert got["open"].confidence == pytest.approx(0.35 + 0.45 * 0.75) and got["open"].t1 - got["open"].t0 == 5 * 3600 + 600  # and the last report under way
    assert A.loitering(A.in_context(df.limit(0), z, learned), z, learned, cfg).count() == 0


def test_gatherings(spark):
    rows = [(f"v{k}", 1000.0 + k, 9000.0, 22.0 + 0.001 * k, 118.0, 60.0, k == 0) for k in range(5)] + [("far", 1000.0, 9000.0, 25.0, 118.0, 60.0, False), ("later", 90_000.0, 99_000.0, 22.0, 118.0, 60.0, False), ("weak", 1000.0, 9000.0, 22.0, 118.0, 30.0, False)]
    df = spark.createDataFrame(rows, "track_id string, t0 double, t1 double, latitude double, longitude double, severity double, own_spot boolean")
    got = {r.track_id: (r.others, r.severity) for r in A.gatherings(df, A.LoiterConfig()).collect()}
    assert got == {"v0": (4, 60.0)} | {f"v{k}": (4, 42.0) for k in range(1, 5)} | {"far": (0, 60.0), "later": (0, 60.0), "weak": (0, 30.0)}


def test_events_and_alerts(world):
    df, z, learned = world
    cfg = A.AnalysisConfig()
    events = A.run_all(df.drop("ship_type"), z, learned, cfg)
    rows = events.orderBy("event").collect()
    assert [r.event for r in rows] == list(range(1, len(rows) + 1)) and [r.t0 for r in rows] == sorted(r.t0 for r in rows)
    kinds = {(r.track_id, r.kind) for r in rows}
    assert {("open", "loitering"), ("inside", "zone_entry"), ("cable", "loitering")} <= kinds and not any(k == "loitering" for v, k in kinds if v in ("port", "moored", "inside"))
    for a in A.alerts(events, cfg).collect():
        own = [r for r in rows if r.track_id == a.track_id and a.t0 <= r.t0 and r.t1 <= a.t1]
        assert len(own) == a.n_events and sorted({r.kind for r in own}) == list(a.kinds)
        left = 1.0
        for kind in {r.kind for r in own}:
            left *= 1 - 0.9 * min(1.0, max(D.KIND_WEIGHT.get(kind, 0.8) * r.severity * (0.6 + 0.4 * r.confidence) / 100 for r in own if r.kind == kind))
        assert a.risk == pytest.approx(100 * (1 - left)) and a.level == ("HIGH" if a.risk >= 75 else "MEDIUM" if a.risk >= 50 else "LOW")
        assert math.isfinite(a.risk)
