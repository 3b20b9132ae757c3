"""Queries of live views in their batch form, of sources and of sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.plans.registry import query
from wakeline.sources import archives as A
from wakeline.sources.fixes import fixes, table
from wakeline.streaming import live


@query("ST1_deduplicated", "SELECT track_id, count(*) AS n FROM (SELECT DISTINCT track_id, base_date_time, longitude, latitude, sog, cog, heading, status FROM (SELECT * FROM fixes UNION ALL SELECT * FROM fixes WHERE event_id % 7 = 0)) GROUP BY track_id")
def deduplicated(spark, sf_dir):
    f = fixes(spark, sf_dir)
    return live.deduplicate(f.union(f.where("event_id % 7 = 0"))).groupBy("track_id").agg(F.count("*").alias("n"))


@query("ST2_latest", "SELECT track_id, arg_max(event_id, (t, event_id)) AS event_id FROM fixes GROUP BY track_id")
def latest(spark, sf_dir):
    return live.latest_batch(fixes(spark, sf_dir)).select("track_id", "event_id")


@query("ST6_snapshot", "WITH s AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t DESC, event_id DESC) AS r FROM fixes WHERE t <= 1705276800) SELECT track_id, event_id FROM s WHERE r = 1 AND 1705276800 - t <= 43200")
def snapshot(spark, sf_dir):
    return live.snapshot(fixes(spark, sf_dir), "2024-01-15 00:00:00", 43_200.0).select("track_id", "event_id")


@query("ST13_area_view", "WITH s AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t DESC, event_id DESC) AS r FROM fixes) SELECT track_id, event_id FROM s WHERE r = 1 AND longitude BETWEEN 119 AND 121 AND latitude BETWEEN 22 AND 25")
def area_view(spark, sf_dir):
    from wakeline.functions.geo import in_box

    return live.latest_batch(fixes(spark, sf_dir)).where(in_box(F.col("longitude"), F.col("latitude"), (119.0, 22.0, 121.0, 25.0))).select("track_id", "event_id")


@query("WN18_last_value", "SELECT track_id, arg_max(sog, (t, event_id)) FILTER (WHERE sog IS NOT NULL) AS last_sog FROM fixes GROUP BY track_id")
def last_value(spark, sf_dir):
    known = F.when(F.col("sog").isNotNull(), F.struct("t", "event_id", "sog"))
    return fixes(spark, sf_dir).groupBy("track_id").agg(F.max(known)["sog"].alias("last_sog"))


@query("IO13_archive_profile", "SELECT count(*) AS reports, count(DISTINCT track_id) AS vessels, round(min(longitude), 6) AS west, round(max(longitude), 6) AS east, round(min(latitude), 6) AS south, round(max(latitude), 6) AS north, round(min(t), 3) AS first, round(max(t), 3) AS last FROM fixes")
def archive_profile(spark, sf_dir):
    out = A.profile(fixes(spark, sf_dir))
    return out.select("reports", "vessels", *[F.round(c, 6).alias(c) for c in ("west", "east", "south", "north")], *[F.round(c, 3).alias(c) for c in ("first", "last")])


@query("IO17_track_features", None)
def track_features(spark, sf_dir):
    return A.track_features(fixes(spark, sf_dir))


@query("IO20_json_frames", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL", views=False)
def json_frames(spark, sf_dir):
    """A field of each event's JSON payload."""
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("IO25_traffic_density", "WITH c AS (SELECT CAST(floor(latitude / 0.5) AS INT) AS ci, CAST(floor(longitude / 0.5) AS INT) AS cj, count(*) AS n FROM fixes GROUP BY ALL) SELECT ci, cj, n, round(ln(1 + n) / max(ln(1 + n)) OVER (), 6) AS density FROM c")
def traffic_density(spark, sf_dir):
    """Reports per cell on a logarithmic scale of the largest."""
    c = fixes(spark, sf_dir).groupBy(F.floor(F.col("latitude") / 0.5).cast("int").alias("ci"), F.floor(F.col("longitude") / 0.5).cast("int").alias("cj")).agg(F.count("*").alias("n"))
    most = c.agg(F.max(F.log1p("n")).alias("most"))
    return c.crossJoin(F.broadcast(most)).select("ci", "cj", "n", F.round(F.log1p("n") / F.col("most"), 6).alias("density"))
