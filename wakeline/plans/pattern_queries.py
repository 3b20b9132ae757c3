"""Queries of movement patterns: turning points and survey-like legs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import identity
from wakeline.operators import clusters as K
from wakeline.operators import detect as D
from wakeline.operators import joins as J
from wakeline.operators import nearest as N
from wakeline.operators import survey as S
from wakeline.operators import turning as T
from wakeline.plans.registry import query
from wakeline.sources.fixes import fixes, zones

#: The driver's reports are hours apart and stay within 24 nm of a point, so windows are long and legs short.
CFG = S.SurveyConfig(gap_s=432_000.0, window_s=864_000.0, min_leg_nm=4.0)


@query(
    "WN17_turning_points",
    """WITH RECURSIVE o AS (SELECT track_id, event_id, latitude AS v, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) AS n FROM fixes),
    s AS (SELECT track_id, n, 0 AS trend, v AS e, event_id AS at, CAST(NULL AS BIGINT) AS turn, 0 AS kind FROM o WHERE n = 1
    UNION ALL SELECT o.track_id, o.n, CASE WHEN s.trend = 0 THEN CASE WHEN abs(o.v - s.e) >= 0.1003e0 THEN CASE WHEN o.v > s.e THEN 1 ELSE -1 END ELSE 0 END WHEN (s.e - o.v) * s.trend >= 0.1003e0 THEN -s.trend ELSE s.trend END,
    CASE WHEN (s.trend = 0 AND abs(o.v - s.e) >= 0.1003e0) OR (s.trend <> 0 AND ((o.v - s.e) * s.trend > 0 OR (s.e - o.v) * s.trend >= 0.1003e0)) THEN o.v ELSE s.e END,
    CASE WHEN (s.trend = 0 AND abs(o.v - s.e) >= 0.1003e0) OR (s.trend <> 0 AND ((o.v - s.e) * s.trend > 0 OR (s.e - o.v) * s.trend >= 0.1003e0)) THEN o.event_id ELSE s.at END,
    CASE WHEN s.trend <> 0 AND (s.e - o.v) * s.trend >= 0.1003e0 THEN s.at END, s.trend FROM s JOIN o ON o.track_id = s.track_id AND o.n = s.n + 1)
    SELECT track_id, turn AS event_id, kind FROM s WHERE turn IS NOT NULL""",
)
def turning_points(spark, sf_dir):
    """Where each vessel's latitude turns back by at least six miles; a track is scanned in pieces of five days."""
    return T.turning_points(fixes(spark, sf_dir), "latitude", 0.1003, piece_s=432_000.0)


def reports(spark, sf_dir):
    """Reports of vessels that don't sail lines for a living; benign: inside a port's square."""
    df = fixes(spark, sf_dir)
    df = df.where(~identity.is_exempt(identity.ship_category(F.col("vessel_type")), F.lit(None).cast("string")))
    ports = J.in_squares(df.select("event_id", "longitude", "latitude"), zones(spark, sf_dir).where("kind = 'port'")).select("event_id", F.lit(True).alias("benign")).distinct()
    return df.join(ports, "event_id", "left")


@query("WN5_survey_stretches")
def survey_stretches(spark, sf_dir):
    """Stretches of overlapping windows with a survey pattern, described by the window with most legs."""
    return S.survey_stretches(reports(spark, sf_dir), CFG)


@query("D10_survey_patterns")
def survey_patterns(spark, sf_dir):
    """Survey patterns as events, more severe near a sensitive zone."""
    events = S.survey_events(reports(spark, sf_dir), CFG).withColumn("event", F.concat_ws(":", "track_id", F.col("t0").cast("string")))
    sensitive = zones(spark, sf_dir).where(F.col("kind").isin("protected", "cable", "restricted")).select("zone_id", F.col("lat_c").alias("site_lat"), F.col("lon_c").alias("site_lon"))
    near = N.nearest_join(events.select("event", "latitude", "longitude"), sensitive, "event", "zone_id", parts=256)
    out = events.join(near, "event", "left").drop("event")
    out = out.withColumn("zone_nm", F.greatest(F.lit(0.0), F.col("nm") - 9))
    return out.withColumn("severity", D.clip(F.col("severity") + F.when(F.col("zone_nm") <= 40, 12).otherwise(0))).drop("nm", "vessel_type")


#: Of reports hours apart, most vessels have one a day.
GROUPS = K.ClusterConfig(step_s=86_400.0, distance_nm=12.0, min_vessels=3, min_s=172_800.0, max_kn=15.0)


def positions(spark, sf_dir):
    """The latest report of each vessel and day."""
    df = fixes(spark, sf_dir).withColumn("step", F.floor(F.col("t") / GROUPS.step_s))
    first = F.row_number().over(W.partitionBy("track_id", "step").orderBy(F.desc("t"), F.desc("event_id")))
    return df.withColumn("_r", first).where("_r = 1").select("step", "track_id", "latitude", "longitude", "sog")


@query("GR2_followed_groups")
def followed_groups(spark, sf_dir):
    """Components of near vessels followed over steps as groups."""
    return K.followed(K.step_groups(positions(spark, sf_dir), GROUPS), GROUPS).select("k0", "k1", "steps", "most", F.concat_ws(",", "core").alias("core"))


@query("D4_clusters")
def clusters(spark, sf_dir):
    """Groups that last, with what their vessels did."""
    return K.clusters(positions(spark, sf_dir), GROUPS).drop("event").withColumn("tracks", F.concat_ws(",", "tracks"))
