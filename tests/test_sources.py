"""Failover, live buffer and analysis: streams against their batch twins, and batches that are run again."""

import os
import random
import shutil

from pyspark.sql import functions as F

from wakeline.streaming import sources as S

CFG = S.FailoverConfig(cloud_stale_s=90.0, edge_stale_s=60.0, hold_s=60.0)


def beats(seed=3, sites=4, span=4000):
    rng = random.Random(seed)
    rows = []
    for site in range(sites):
        up = {S.CLOUD: True, S.EDGE: True}
        for t in range(0, span, 20):
            for s in up:
                if rng.random() < 0.06:
                    up[s] = not up[s]
                if up[s] and rng.random() < 0.8:
                    rows.append((site, 1_700_000_000.0 + t + rng.randrange(0, 19), s))
    return rows


def plain(rows):
    """Second by second."""
    out = []
    for site in sorted({r[0] for r in rows}):
        own = {s: sorted(t for x, t, o in rows if x == site and o == s) for s in (S.CLOUD, S.EDGE)}
        begin = min(t for ts in own.values() for t in ts[:1])
        mode, since = None, None
        for t in range(int(begin), int(begin) + 4600):
            fresh = {}
            for s, most in ((S.CLOUD, 90), (S.EDGE, 60)):
                last = [x for x in own[s] if x <= t][-1:]
                fresh[s] = bool(last) and t - last[0] <= most
            if fresh[S.CLOUD] and mode == S.EDGE and fresh[S.EDGE]:
                since = since if since is not None else t
                new = S.CLOUD if t - since >= 60 else S.EDGE
            else:
                new = S.CLOUD if fresh[S.CLOUD] else S.EDGE if fresh[S.EDGE] else S.NONE
            if new != S.EDGE or not fresh[S.CLOUD]:
                since = None
            if new != mode:
                out.append((site, float(t), new))
            mode = new
    return out


def test_failover(spark):
    rows = beats()
    df = spark.createDataFrame(rows + [(None, 1.0, S.CLOUD), (1, None, S.EDGE), (1, 5.0, "radio")], "site_id long, t double, source string")
    want = plain(rows)
    assert sorted(tuple(r) for r in S.failover(df, CFG).collect()) == sorted(want) and {m for _, _, m in want} == {S.CLOUD, S.EDGE, S.NONE}
    assert S.failover(df.limit(0), CFG).count() == 0


def test_failover_stream_with_late_and_missing_heartbeats(spark, tmp_path):
    """Heartbeats arrive shuffled within the delay, over several batches; timers tell when a site goes silent."""
    rows = sorted(beats(5, 3, 1500), key=lambda r: r[1])
    want = sorted(plain(rows))
    folder, rng = tmp_path / "in", random.Random(1)
    folder.mkdir()
    late = [(r, r[1] + rng.uniform(0, 25)) for r in rows]  # arrival
    late.sort(key=lambda x: x[1])
    parts = [[r for r, a in late if lo <= a - 1_700_000_000 < lo + 300] for lo in range(0, 1800, 300)]
    parts.append([(99, 1_700_000_000.0 + 9000, S.CLOUD)])  # moves the watermark on
    parts.append([(99, 1_700_000_000.0 + 9001, S.CLOUD)])
    for k, part in enumerate(parts):
        if part:
            spark.createDataFrame(part, "site_id long, t double, source string").select("site_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("at"), "source").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
            name = next(n for n in os.listdir(tmp_path / f"p{k}") if n.endswith(".parquet"))
            shutil.copy(tmp_path / f"p{k}" / name, folder / f"{k:02d}.parquet")
            os.utime(folder / f"{k:02d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("site_id long, at timestamp, source string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = S.failover_stream(stream, CFG).writeStream.format("memory").queryName("modes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.sql("select * from modes where site_id <> 99").collect())
    assert got == want


def test_active_view(spark):
    rows = [(0, 100.0, S.CLOUD), (0, 150.0, S.EDGE), (0, 190.0, S.EDGE), (0, 230.0, S.EDGE), (1, 100.0, S.CLOUD), (1, 180.0, S.CLOUD)]
    hb = spark.createDataFrame(rows, "site_id long, t double, source string")
    pos = spark.createDataFrame([(0, S.CLOUD, "a", 1, 90.0), (0, S.CLOUD, "b", 2, 95.0), (0, S.EDGE, "b", 3, 200.0), (0, S.EDGE, "c", 4, 210.0), (0, S.EDGE, "c", 5, 260.0), (1, S.CLOUD, "a", 6, 170.0), (1, S.EDGE, "z", 7, 170.0)], "site_id long, source string, track_id string, event_id long, t double")
    see = lambda at: sorted((r.site_id, r.track_id, r.event_id, r.display) for r in S.active_view(S.failover(hb, CFG), hb, pos, at, CFG).collect())
    assert see(240.0) == [(0, "a", 1, "STALE"), (0, "b", 3, "LIVE"), (0, "c", 4, "LIVE"), (1, "a", 6, "LIVE")]
    assert see(180.0) == [(0, "a", 1, "LIVE"), (0, "b", 2, "LIVE"), (1, "a", 6, "LIVE")]


def test_live_analysis_of_a_batch_run_again(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"v{k % 7}", k, 1000.0 * (k // 7), 20 + rng.random(), None if k % 60 == 0 else 120.0) for k in range(210)]
    schema = "track_id string, event_id long, t double, latitude double, longitude double"
    keep = lambda df: S.bounded(df, retention_s=9000.0, points=6, vessels=5, stale_s=4000.0)
    live = S.LiveAnalysis(str(tmp_path), lambda df: df.groupBy("track_id").agg(F.count("*").alias("n"), F.max("t").alias("last")), keep)
    seen = []
    for number in range(3):
        part = rows[70 * number : 70 * (number + 1)]
        batch = spark.createDataFrame(part, schema)
        seen += part
        for _ in range(2 if number else 1):  # batches 1 and 2 are run twice
            live(batch, number)
        now = max(r[2] for r in seen)
        last = sorted({r[0] for r in seen}, key=lambda v: (-max(r[2] for r in seen if r[0] == v), v))[:5]
        want = sorted((r[0], r[1]) for v in last for r in sorted((r for r in seen if r[0] == v and r[2] >= now - 9000), key=lambda r: -r[1])[:6])
        got = spark.read.parquet(f"{tmp_path}/buffer/batch={number}")
        assert sorted((r.track_id, r.event_id) for r in got.collect()) == want
        alerts = spark.read.parquet(f"{tmp_path}/alerts/batch={number}").collect()
        assert sorted((r.track_id, r.n) for r in alerts) == sorted((v, sum(a == v for a, _ in want)) for v in last)
    status = {r.batch: (r.vessels, r.status) for r in spark.read.parquet(f"{tmp_path}/status").collect()}
    assert status == {0: (5, "ready"), 1: (5, "ready"), 2: (5, "ready")}
    assert not os.path.exists(f"{tmp_path}/buffer/batch=0")
    live(spark.createDataFrame([], schema), 7)
    assert spark.read.parquet(f"{tmp_path}/status/batch=7").first().status == "unavailable"


def test_buffer_as_a_stream(spark, tmp_path):
    rows = [(f"v{k % 3}", k, 10.0 * k, 20.0, 120.0) for k in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "track_id string, event_id long, t double, latitude double, longitude double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = S.LiveAnalysis(str(tmp_path / "out"), lambda df: df.select("track_id"), lambda df: S.bounded(df, points=4))
    stream = spark.readStream.schema("track_id string, event_id long, t double, latitude double, longitude double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(live).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out/buffer/batch=2")).collect()) == list(range(48, 60))
