"""Boundaries of sessions, windows, joins and sources, on hand-made rows."""

import struct

import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo, identity
from wakeline.operators import context as C
from wakeline.operators import detect as D
from wakeline.operators import joins as J
from wakeline.operators import ranking as R
from wakeline.operators import tracks as T
from wakeline.sources import archives as A


def reports(spark, rows):
    """rows: (track, t, lat, lon, sog, cog)"""
    full = [(k, r[0], float(r[1]), *map(float, r[2:4]), *[None if x is None else float(x) for x in r[4:6]], None, 70, r[6] if len(r) > 6 else 0) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "event_id long, track_id string, t double, latitude double, longitude double, sog double, cog double, heading double, vessel_type int, status int")


def test_gap_is_strict(spark):
    df = reports(spark, [("a", t, 0, 0, 5, 0) for t in (0, 600, 1201, 1801)])
    assert [r.segment_ordinal for r in T.segments(df, T.TrackConfig()).orderBy("t").collect()] == [1, 1, 2, 2]


def test_windows_are_full_and_half_open(spark):
    cfg = T.TrackConfig(segment_gap_s=1e9, window_s=100, stride_s=50)
    df = reports(spark, [("a", t, 0, 0, 5, 0) for t in (0, 99, 100, 200)])
    got = {}
    for r in T.windows(T.segments(df, cfg), cfg).collect():
        got.setdefault(r.window_ordinal, set()).add(r.t)
    assert got == {0: {0.0, 99.0}, 1: {99.0, 100.0}, 2: {100.0}}  # 200 ends the last window, in none


def test_count_before_span(spark):
    cfg = T.TrackConfig(segment_gap_s=1e9, window_s=100, stride_s=100, min_observations=3, min_span_s=90)
    df = reports(spark, [("a", 0, 0, 0, 5, 0), ("a", 10, 0, 0, 5, 0), ("a", 100, 0, 0, 5, 0), ("a", 110, 0, 0, 5, 0), ("a", 120, 0, 0, 5, 0), ("a", 200, 0, 0, 5, 0)])
    assert {r.window_ordinal: r.quality for r in T.window_table(T.windows(T.segments(df, cfg), cfg), cfg).collect()} == {0: "too_few_reports", 1: "span_too_short"}


def test_low_speed_needs_both_ends(spark):
    cfg = T.TrackConfig(segment_gap_s=1e9, window_s=400, stride_s=400, min_observations=2, min_span_s=1)
    df = reports(spark, [("a", 0, 0, 0, 1, 0), ("a", 100, 0, 0, 2, 10), ("a", 200, 0, 0, 9, 350), ("a", 300, 0, 0, 1, 5), ("a", 400, 0, 0, 1, 5)])
    w = T.window_table(T.windows(T.segments(df, cfg), cfg), cfg).first()
    assert w.low_speed_s == 100 and w.n_course_pairs == 3 and w.turn_sum == pytest.approx(10 + 20 + 15) and w.displacement_m == 0 and w.path_ratio is None


def test_path_has_no_leg_before_the_first_report(spark):
    cfg = T.TrackConfig(segment_gap_s=1e9, window_s=200, stride_s=200, min_observations=2, min_span_s=1)
    df = reports(spark, [("a", 0, 0, 0, 9, 0), ("a", 100, 0, 0.01, 9, 0), ("a", 200, 0, 0.02, 9, 0)])
    w = T.window_table(T.windows(T.segments(df, cfg), cfg), cfg).first()
    assert w.path_m == pytest.approx(1111.95, abs=0.1) and w.displacement_m == pytest.approx(1111.95, abs=0.1)
    assert spark.range(1).select(geo.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()[0] is None


def test_resampled_route(spark):
    from wakeline.operators import routes

    df = reports(spark, [("a", 0, 0, 0, 9, 0), ("a", 1, 0, 1, 9, 0), ("a", 2, 0, 4, 9, 0), ("b", 0, 1, 1, 9, 0), ("b", 9, 1, 1, 9, 0)])
    got = {r.anchor: r.longitude for r in routes.resample(df, 5).collect()}
    assert got == pytest.approx({0: 0, 1: 1, 2: 2, 3: 3, 4: 4}, abs=1e-6)


def test_partitions_do_not_matter(spark):
    cfg = T.TrackConfig(segment_gap_s=500, window_s=300, stride_s=100, min_observations=2, min_span_s=1)
    df = reports(spark, [(f"v{k % 3}", 37 * k % 2000, k % 7, k % 5, k % 11, 31 * k % 360) for k in range(300)])
    run = lambda d: sorted(map(str, T.window_table(T.windows(T.segments(d, cfg), cfg), cfg).collect()))
    assert run(df.coalesce(1)) == run(df.repartition(9))


def test_whole_tracks(spark):
    df = reports(spark, [(v, t, 0, 0, 1, 1) for v, n in (("a", 4), ("b", 9), ("c", 3)) for t in range(n)])
    assert {r.track_id for r in T.whole_tracks(df, 8).collect()} == {"a", "c"}


def test_circle_and_geometry(spark):
    row = spark.range(1).select(
        geo.circular_difference(F.lit(350.0), F.lit(10.0)).alias("a"),
        geo.circular_difference(F.lit(10.0), F.lit(190.0)).alias("b"),
        geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"),
        geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("n"),
        *[x.alias(k) for k, x in zip("xy", geo.destination(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(111195.08)), strict=True)],
    ).first()
    assert row.a == 20 and row.b == -180 and row.d == pytest.approx(111195.08, abs=0.1) and row.n == 0 and row.y == pytest.approx(1, abs=1e-5)


def test_polygon(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ((0, 0), (0, 4), (4, 4), (2, 2), (4, 0))])
    pts = spark.createDataFrame([(1.0, 2.0, True), (3.5, 2.0, False), (3.0, 0.5, True), (5.0, 5.0, False)], "lat double, lon double, inside boolean")
    assert all(r.x == r.inside for r in pts.withColumn("x", geo.in_polygon(F.col("lat"), F.col("lon"), ring)).collect())


def test_identity(spark):
    import base64
    import hashlib
    import hmac

    rows = [("416000123", True, True, True), ("199000123", False, False, True), ("111111111", False, False, False), ("123456789", False, False, False), ("800123456", False, False, True), ("41600012", False, False, False), (None, False, False, False)]
    m = F.col("m")
    got = spark.createDataFrame([r[:1] for r in rows], "m string").select(m, identity.valid_mid(m), identity.vessel_mmsi(m), identity.plausible_mmsi(m)).collect()
    assert {tuple(r) for r in got} == set(rows)
    key = b"secret"
    want = "v_" + base64.urlsafe_b64encode(hmac.new(key, b"416000123", hashlib.sha256).digest()[:18]).decode()
    assert spark.createDataFrame([("416000123",)], "m string").select(identity.keyed_id(m, key)).first()[0] == want
    imos = spark.createDataFrame([("IMO 9074729", True), ("9074728", False), ("907472", False), (None, False)], "i string, ok boolean")
    assert all(r.x == r.ok for r in imos.withColumn("x", identity.imo_valid(F.col("i"))).collect())


def test_asof_and_interpolation(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", 10.0), ("a", 1.0), ("b", 3.0)], "k string, t double")
    right = spark.createDataFrame([("a", 2.0, 10.0), ("a", 10.0, 30.0), ("a", 12.0, 50.0)], "k string, t double, v double")
    back = {(r.k, r.t): r.v for r in J.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert back == {("a", 5.0): 10.0, ("a", 10.0): 30.0, ("a", 1.0): None, ("b", 3.0): None}
    ahead = {(r.k, r.t): r.v for r in J.asof_forward(left, right, ["k"], "t", ["v"]).collect()}
    assert ahead == {("a", 5.0): 30.0, ("a", 10.0): 30.0, ("a", 1.0): 10.0, ("b", 3.0): None}
    mid = {(r.k, r.t): r.v for r in J.interpolate(left, right, ["k"], "t", ["v"], 3.0).collect()}
    assert mid[("a", 5.0)] == pytest.approx(17.5) and mid[("a", 10.0)] == 30.0 and mid[("a", 1.0)] is None


def test_range_joins(spark):
    pts = spark.createDataFrame([("a", float(x)) for x in range(0, 100, 7)], "k string, t double")
    spans = spark.createDataFrame([("a", 0.0, 0.0, 1), ("a", 10.0, 95.0, 2), ("b", 0.0, 99.0, 3)], "k string, lo double, hi double, s int")
    got = sorted((r.t, r.s) for r in J.range_bucket_join(pts, spans, ["k"], "t", "lo", "hi", 13.0).collect())
    assert got == sorted([(0.0, 1), *[(float(x), 2) for x in range(14, 92, 7)]])
    other = spark.createDataFrame([("a", 90.0, 120.0), ("a", 96.0, 99.0), ("a", 1.0, 2.0)], "k string, x double, y double")
    meet = sorted((r.s, r.x) for r in J.overlap_join(spans, other, ["k"], ("lo", "hi"), ("x", "y"), 13.0, 1.0).collect())
    assert meet == [(1, 1.0), (2, 90.0), (2, 96.0)]


def test_cell_self_join_finds_all(spark):
    import math
    import random

    rng = random.Random(2)
    pts = [(i, rng.random() * 3, rng.random() * 3) for i in range(120)]
    df = spark.createDataFrame([(i, 0, x, y) for i, x, y in pts], "i int, k int, x double, y double")
    got = {(r.i, r.i2) for r in J.cell_self_join(df, ["k"], "i", "x", "y", 0.3).where("sqrt(pow(x - x2, 2) + pow(y - y2, 2)) <= 0.3").collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 0.3}


def test_detectors(spark):
    df = reports(spark, [("a", 0, 0, 0, 5, 0), ("a", 3600, 0, 0.1, 5, 0), ("a", 90_000, 0, 0.2, 5, 0), ("b", 0, 0, 0, 5, 0, 1), ("b", 90_000, 0, 1, 5, 0, 1), ("c", 0, 0, 0, 5, 0), ("c", 3600, 5, 0, 5, 0), ("c", 7200, 0, 0, 5, 0)])
    gaps = D.gaps(df, D.DetectConfig()).collect()
    assert {(r.track_id, r.t0) for r in gaps} == {("a", 0.0), ("a", 3600.0), ("c", 0.0), ("c", 3600.0)}
    jumps = D.jumps(df, D.DetectConfig()).collect()
    assert [(r.track_id, r.kind, r.n) for r in jumps] == [("c", "position_jump", 2)]
    risk = D.risk(spark.createDataFrame([("a", "position_jump", 80.0, 0.8), ("a", "position_jump", 10.0, 0.8), ("a", "ais_gap", 50.0, 0.5)], "track_id string, kind string, severity double, confidence double"), ["track_id"]).first()
    p, q = 0.9 * 80 * (0.6 + 0.32) / 100, 0.8 * 50 * 0.8 / 100
    assert risk.risk == pytest.approx(100 * (1 - (1 - 0.9 * p) * (1 - 0.9 * q)))


def test_densify_and_peers(spark):
    df = reports(spark, [("a", 0, 0, 0, 10, 0), ("a", 1800, 0, 5 / 60, 10, 0), ("a", 90_000, 0, 2, 10, 0)])
    got = C.densify(df).orderBy("t").collect()
    assert len(got) == 8 and got[1].t == pytest.approx(300, rel=0.05)  # six pieces (5.003 nm), then two plain points
    gaps = spark.createDataFrame([(1, float(g)) for g in (1, 2, 2, 3)], "vessel_type int, gap double")
    assert sorted(r.peer for r in C.peer_percentile(gaps, 4).collect()) == [0, 0.25, 0.25, 0.75]
    assert all(r.peer is None for r in C.peer_percentile(gaps, 5).collect())


def test_midranks_and_auc(spark):
    ref = spark.createDataFrame([("f", float(x)) for x in (1, 2, 2, 4)], "feature string, value double")
    q = spark.createDataFrame([("f", 2.0), ("f", 3.0), ("f", 0.0), ("f", None)], "feature string, value double")
    assert {r.value: r.p for r in R.midranks(ref, q, ["feature"]).collect()} == {2.0: 0.5, 3.0: 0.75, 0.0: 0.0, None: None}
    d = spark.createDataFrame([(1, 3.0), (0, 1.0), (1, 1.0), (0, 0.0)], "y int, s double")
    assert R.roc_auc(d, F.col("y"), F.col("s")).first().auc == pytest.approx((2 + 1.5) / 4)


def test_sources(spark, tmp_path):
    rows = [(" 416 ", "2024-01-01T00:00:01", "121.5", "23.1", "x"), ("417", "1704067200000", "0", "0", "1.5"), ("418", "nonsense", "1", "2", "200")]
    df = spark.createDataFrame(rows, "MMSI string, BaseDateTime string, LON string, LAT string, SOG string")
    got = {r.vessel_id: r for r in A.sentinels_to_null(A.select_by_alias(df.withColumn("COG", F.lit("360")))).collect()}
    assert set(got) == {"416", "418"} and got["416"].sog is None and got["418"].sog is None and got["418"].base_date_time is None and got["418"].cog is None
    assert A.select_by_alias(df).where("vessel_id = '417'").first().base_date_time.year == 2024
    with pytest.raises(ValueError):
        A.select_by_alias(df.drop("LAT"))
    (tmp_path / "n.csv").write_text('31/12/2023 23:59:00,Class A,219000001,"55,5","12,25",Under way,0,"7,5","180,0"\n31/12/2023 23:59:00,Base Station,2,"1,0","1,0",x,0,,\n')
    r = A.read_national_csv(spark, f"file://{tmp_path}/n.csv").collect()
    assert len(r) == 1 and (r[0].latitude, r[0].longitude, r[0].sog, r[0].cog) == (55.5, 12.25, 7.5, 180.0) and r[0].base_date_time.month == 12
    (tmp_path / "d.json").write_text('{"entries": [{"set-1": [{"date": "d", "lat": 1.5, "lon": 2.0, "vesselId": "v"}, {"date": "e", "lat": 3.0, "vesselId": "w"}]}, {"set-2": []}]}')
    assert {(r.dataset, r.vesselId, r.lat) for r in A.read_nested_daily(spark, f"file://{tmp_path}/d.json").collect()} == {("set-1", "v", 1.5), ("set-1", "w", 3.0)}
    blobs = [(1, struct.pack("<BIdd", 1, 1, 121.5, 23.5)), (2, struct.pack(">BIdd", 0, 1, -1.0, 2.0)), (3, b"\1"), (4, None), (5, struct.pack("<BII", 1, 2, 0) + b"\0" * 16)]
    p = {r.i: (r.longitude, r.latitude) for r in A.wkb_points(spark.createDataFrame(blobs, "i int, b binary"), "b").collect()}
    assert p == {1: (121.5, 23.5), 2: (-1.0, 2.0), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, x int")
    facts = {"source": "s", "crs": "EPSG:4326", "time_zone": "UTC"}
    A.write_with_manifest(df, f"file://{tmp_path}/a", facts)
    assert spark.read.json(f"file://{tmp_path}/a.manifest").count() == 4
    with pytest.raises(Exception, match="exists"):
        A.write_with_manifest(df, f"file://{tmp_path}/a", facts)
    with pytest.raises(ValueError):
        A.write_with_manifest(df, f"file://{tmp_path}/b", {"source": "s"})
    out = f"file://{tmp_path}/days"
    assert A.write_new_days(df, out, "day", spark).count() == 2
    more = df.union(spark.createDataFrame([("2024-01-03", 3)], df.schema))
    built = spark.read.schema("x int, day string").parquet(out)
    assert [r.day for r in A.write_new_days(more, out, "day", spark, built).collect()] == ["2024-01-03"]
    assert spark.read.schema("x int, day string").parquet(out).count() == 3


def test_streams_match_batch(spark, tmp_path):
    from wakeline.streaming import live

    base = "2024-01-01 00:00:00"
    rows = [(k, f"v{k % 3}", base, 120.0 + k * 0.01, 23.0, 5.0, 1.0, 2.0, 0) for k in range(30)]
    schema = "event_id long, track_id string, at string, longitude double, latitude double, sog double, cog double, heading double, status int"
    df = spark.createDataFrame(rows, schema).withColumn("base_date_time", F.to_timestamp("at") + F.make_interval(secs=F.col("event_id") * 40 - F.when(F.col("event_id") % 7 == 0, 300).otherwise(0))).drop("at")
    src = f"file://{tmp_path}/in"
    for k in range(3):
        df.where(F.floor(F.col("event_id") / 10) == k).coalesce(1).write.mode("append").parquet(src)
    df.where("event_id % 5 = 0").coalesce(1).write.mode("append").parquet(src)

    def drain(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name)

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    once = drain(live.deduplicate(stream), "once", "append")
    assert sorted(r.event_id for r in once.collect()) == sorted(r.event_id for r in live.deduplicate(spark.read.schema(df.schema).parquet(src)).collect())
    rolled = drain(live.rolling(stream, minutes=5.0, stale=600.0), "rolled", "update")
    newest = {}
    for r in rolled.collect():
        if r.track_id not in newest or r.base_date_time >= newest[r.track_id].base_date_time:
            newest[r.track_id] = r
    want = {r.track_id: r.event_id for r in live.latest_batch(df).collect()}
    assert {k: r.event_id for k, r in newest.items()} == want
    assert all(1 <= r.n_points <= 5 for r in newest.values())
