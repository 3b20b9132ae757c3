"""Queries for behaviour detectors, their fusion, and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import detect as D
from wakeline.operators import joins as J
from wakeline.plans.context_queries import TRUTH, truth
from wakeline.plans.registry import haversine, query
from wakeline.plans.track_queries import WIN, window_features
from wakeline.sources.fixes import fixes, zones

CFG = D.DetectConfig(gap_min_s=86_400.0, static_min_fixes=1, static_min_s=0.0, static_min_nm=0.0, jump_link_s=86_400.0)
BASE = {"cable": 58.0, "restricted": 55.0, "protected": 45.0}
CLIP = "least(greatest({}, 0), 100)"
LEGS = "lg AS (SELECT *, lag(t) OVER p AS pt, lag(latitude) OVER p AS pla, lag(longitude) OVER p AS plo, lag(sog) OVER p AS psog, lag(status) OVER p AS pst FROM fixes WINDOW p AS (PARTITION BY track_id ORDER BY t, event_id)), lm AS (SELECT *, t - pt AS dt, " + haversine("pla", "plo", "latitude", "longitude") + " / 1852 AS nm FROM lg), ll AS (SELECT *, CASE WHEN dt > 0 THEN nm / greatest(dt, 1) * 3600 ELSE 0 END AS kn FROM lm)"
GAPS = LEGS + ", ga AS (SELECT track_id, event_id, 'ais_gap' AS kind, pt AS t0, t AS t1, least(greatest(CASE WHEN nm < 1 THEN least(28, 35 + 30 * least(1, (dt - 86400) / 259200) + CASE WHEN coalesce(psog, 0) >= 4 THEN 8 ELSE 0 END + CASE WHEN kn > 60 THEN 12 ELSE 0 END) ELSE 35 + 30 * least(1, (dt - 86400) / 259200) + CASE WHEN coalesce(psog, 0) >= 4 THEN 8 ELSE 0 END + CASE WHEN kn > 60 THEN 12 ELSE 0 END END, 0), 100) AS severity, 0.55e0 AS confidence, nm < 1 AS stationary FROM ll WHERE dt >= 86400 AND NOT coalesce(pst IN (1, 5, 6), false))"
JUMPS = "jb AS (SELECT *, CASE WHEN pt - lag(pt) OVER (PARTITION BY track_id ORDER BY pt, event_id) <= 86400 THEN 0 ELSE 1 END AS k FROM ll WHERE kn >= 60 AND nm >= 4), jr AS (SELECT *, sum(k) OVER (PARTITION BY track_id ORDER BY pt, event_id ROWS UNBOUNDED PRECEDING) AS run FROM jb), jg AS (SELECT track_id, run, count(*) AS n, min(pt) AS t0, max(t) AS t1, max(nm) AS jump_nm, max(kn) AS peak FROM jr GROUP BY track_id, run), ju AS (SELECT track_id, CASE WHEN n >= 4 THEN 'identity_conflict' ELSE 'position_jump' END AS kind, t0, t1, n, jump_nm, least(greatest(CASE WHEN n >= 4 THEN 78 + 12 * least(1, n / 20) ELSE 60 + 20 * least(1, peak / 240) + CASE WHEN n >= 2 THEN 8 ELSE 0 END END, 0), 100) AS severity, CASE WHEN n >= 4 THEN 0.85e0 ELSE 0.8e0 END AS confidence FROM jg)"
STATUS = "sf AS (SELECT *, status IN (1, 5, 6) AND coalesce(sog, 0) >= 3 AS fl FROM fixes), sr AS (SELECT *, sum(CASE WHEN fl THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM sf), sg AS (SELECT track_id, run, count(*) AS n, min(t) AS t0, max(t) AS t1, quantile_cont(sog, 0.5) AS kn FROM sr WHERE fl GROUP BY track_id, run), sm AS (SELECT track_id, 'status_mismatch' AS kind, t0, t1, n, least(greatest(48 + 20 * least(1, (t1 - t0) / 3600) + 8 * least(1, kn / 12), 0), 100) AS severity, 0.75e0 AS confidence FROM sg)"
ZONES = "zi AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) AS i FROM fixes), zj AS (SELECT zi.*, z.zone_id, z.kind AS zk FROM zi JOIN zones z ON abs(zi.longitude - z.lon_c) <= z.half_deg AND abs(zi.latitude - z.lat_c) <= z.half_deg WHERE z.kind IN ('cable', 'restricted', 'protected')), zr AS (SELECT *, i - row_number() OVER (PARTITION BY track_id, zone_id ORDER BY i) AS run FROM zj), zg AS (SELECT track_id, zone_id, zk, run, count(*) AS n, min(t) AS t0, max(t) AS t1, min(sog) AS lk FROM zr GROUP BY ALL), ze AS (SELECT track_id, zone_id, 'zone_entry' AS kind, zk, t0, t1, n, least(greatest(CASE zk WHEN 'cable' THEN 58 WHEN 'restricted' THEN 55 ELSE 45 END + 8 * least(1, (t1 - t0) / 3600) + CASE WHEN coalesce(lk, 0) < 3 AND t1 - t0 > 600 THEN 15 WHEN t1 - t0 <= 600 THEN -18 ELSE 0 END, 0), 100) AS severity, 0.8e0 AS confidence FROM zg)"
EVENTS = "WITH " + GAPS + ", " + JUMPS + ", " + STATUS + ", " + ZONES + ", ev AS (SELECT track_id, kind, t0, t1, severity, confidence FROM ga UNION ALL SELECT track_id, kind, t0, t1, severity, confidence FROM ju UNION ALL SELECT track_id, kind, t0, t1, severity, confidence FROM sm UNION ALL SELECT track_id, kind, t0, t1, severity, confidence FROM ze)"
WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in D.KIND_WEIGHT.items()) + " ELSE 0.8e0 END"
RISK = ", pk AS (SELECT track_id, kind, max(" + WEIGHT + " * severity * (0.6e0 + 0.4e0 * confidence) / 100) AS p FROM ev GROUP BY ALL), rk AS (SELECT track_id, count(*) AS kinds, 100 * (1 - exp(sum(ln(1 - 0.9e0 * least(p, 1))))) AS risk FROM pk GROUP BY track_id)"


def events(spark, sf_dir):
    f = fixes(spark, sf_dir)
    found = [D.gaps(f, CFG), D.jumps(f, CFG), D.status_mismatch(f, CFG), D.zone_entries(f, zones(spark, sf_dir), CFG, BASE)]
    out = None
    for e in found:
        e = e.select("track_id", "kind", "t0", "t1", "severity", "confidence")
        out = e if out is None else out.unionByName(e)
    return out


def _times(df):
    return df.withColumns({c: F.round(c, 3) for c in ("t0", "t1") if c in df.columns}).withColumn("severity", F.round("severity", 6))


@query("D1_reporting_gaps", "WITH " + GAPS + " SELECT event_id, track_id, round(t0, 3) AS t0, round(t1, 3) AS t1, round(severity, 6) AS severity, stationary FROM ga")
def reporting_gaps(spark, sf_dir):
    return _times(D.gaps(fixes(spark, sf_dir), CFG)).select("event_id", "track_id", "t0", "t1", "severity", "stationary")


@query("D7_position_jumps", "WITH " + LEGS + ", " + JUMPS + " SELECT track_id, kind, round(t0, 3) AS t0, round(t1, 3) AS t1, n, round(jump_nm, 5) AS jump_nm, round(severity, 6) AS severity FROM ju")
def position_jumps(spark, sf_dir):
    return _times(D.jumps(fixes(spark, sf_dir), CFG)).select("track_id", "kind", "t0", "t1", "n", F.round("jump_nm", 5).alias("jump_nm"), "severity")


@query("D9_status_mismatch", "WITH " + STATUS + " SELECT track_id, round(t0, 3) AS t0, round(t1, 3) AS t1, n, round(severity, 6) AS severity FROM sm")
def status_mismatch(spark, sf_dir):
    return _times(D.status_mismatch(fixes(spark, sf_dir), CFG)).select("track_id", "t0", "t1", "n", "severity")


@query("D5_zone_entries", "WITH " + ZONES + " SELECT track_id, zone_id, zk AS zone_kind, round(t0, 3) AS t0, round(t1, 3) AS t1, n, round(severity, 6) AS severity FROM ze")
def zone_entries(spark, sf_dir):
    return _times(D.zone_entries(fixes(spark, sf_dir), zones(spark, sf_dir), CFG, BASE)).select("track_id", "zone_id", "zone_kind", "t0", "t1", "n", "severity")


@query("D6_zone_habits", "WITH " + ZONES + " SELECT zone_id, count(DISTINCT track_id) AS visitors, count(*) AS visits FROM ze GROUP BY zone_id")
def zone_habits(spark, sf_dir):
    e = D.zone_entries(fixes(spark, sf_dir), zones(spark, sf_dir), CFG, BASE)
    return e.groupBy("zone_id").agg(F.count_distinct("track_id").alias("visitors"), F.count("*").alias("visits"))


@query("J23_unusual_visits", "WITH " + ZONES + ", h AS (SELECT zone_id, track_id FROM ze WHERE t0 < 1705276800 GROUP BY ALL) SELECT track_id, zone_id, round(t0, 3) AS t0 FROM ze WHERE t0 >= 1705276800 AND NOT EXISTS (SELECT 1 FROM h WHERE h.zone_id = ze.zone_id AND h.track_id = ze.track_id)")
def unusual_visits(spark, sf_dir):
    """Visits of the second half of the month by vessels that weren't in the zone in the first."""
    e = D.zone_entries(fixes(spark, sf_dir), zones(spark, sf_dir), CFG, BASE)
    cut = 1705276800.0
    habits = e.where(F.col("t0") < cut).select("zone_id", "track_id").distinct()
    return e.where(F.col("t0") >= cut).join(habits, ["zone_id", "track_id"], "left_anti").select("track_id", "zone_id", F.round("t0", 3).alias("t0"))


@query("AG31_events_by_kind", EVENTS + " SELECT kind, count(*) AS n, count(DISTINCT track_id) AS vessels FROM ev GROUP BY kind")
def events_by_kind(spark, sf_dir):
    return events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("vessels"))


@query("AG33_risk", EVENTS + RISK + " SELECT track_id, kinds, round(risk, 6) AS risk, CASE WHEN risk >= 75 THEN 'HIGH' WHEN risk >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM rk")
def risk(spark, sf_dir):
    out = D.risk(events(spark, sf_dir), ["track_id"])
    return out.select("track_id", F.size("kinds").cast("long").alias("kinds"), F.round("risk", 6).alias("risk"), "level")


@query("WN9_alert_groups", EVENTS + ", lk AS (SELECT *, CASE WHEN t0 - lag(t1) OVER p <= 21600 THEN 0 ELSE 1 END AS k FROM ev WINDOW p AS (PARTITION BY track_id ORDER BY t0, t1, kind)), al AS (SELECT *, sum(k) OVER (PARTITION BY track_id ORDER BY t0, t1, kind ROWS UNBOUNDED PRECEDING)::BIGINT AS alert FROM lk) SELECT track_id, alert, count(*) AS n_events, round(min(t0), 3) AS t0, round(max(t1), 3) AS t1 FROM al GROUP BY track_id, alert")
def alert_groups(spark, sf_dir):
    g = D.link_groups(events(spark, sf_dir), 21_600.0).groupBy("track_id", "alert")
    return g.agg(F.count("*").alias("n_events"), F.round(F.min("t0"), 3).alias("t0"), F.round(F.max("t1"), 3).alias("t1"))


@query("AG36_event_recall", EVENTS + ", " + TRUTH + ", x AS (SELECT DISTINCT tr.truth_id, kind FROM tr JOIN ev ON ev.track_id = 'v' || lpad(CAST(tr.user_id AS VARCHAR), 6, '0') AND ev.t0 - 3600 <= tr.t1 AND ev.t1 + 3600 >= tr.t0), n AS (SELECT count(*) AS n FROM tr WHERE user_id IN (SELECT user_id FROM fixes)) SELECT kind, count(*) AS hit, round(count(*) / max(n.n), 6) AS recall FROM x, n GROUP BY kind")
def event_recall(spark, sf_dir):
    """Truth intervals of reporting vessels that an event of each kind meets, within an hour."""
    f = fixes(spark, sf_dir)
    tr = truth(spark, sf_dir).join(f.select("user_id", "track_id").distinct(), "user_id")
    meet = J.overlap_join(events(spark, sf_dir), tr.select("track_id", "truth_id", "a0", "a1"), ["track_id"], ("t0", "t1"), ("a0", "a1"), 86_400.0, 3600.0)
    total = tr.agg(F.count("*").alias("total"))
    hit = meet.select("truth_id", "kind").distinct().groupBy("kind").agg(F.count("*").alias("hit"))
    return hit.crossJoin(F.broadcast(total)).select("kind", "hit", F.round(F.col("hit") / F.col("total"), 6).alias("recall"))


@query("AG47_level_by_zone", EVENTS + RISK + ", lv AS (SELECT DISTINCT ze.zone_id, rk.track_id, CASE WHEN risk >= 75 THEN 3 WHEN risk >= 50 THEN 2 ELSE 1 END AS lv FROM ze JOIN rk USING (track_id)) SELECT zone_id, max(lv) AS level, count(*) AS vessels FROM lv GROUP BY zone_id")
def level_by_zone(spark, sf_dir):
    """The highest alert level of the vessels that entered each zone."""
    level = F.element_at(F.create_map(F.lit("HIGH"), F.lit(3), F.lit("MEDIUM"), F.lit(2), F.lit("LOW"), F.lit(1)), F.col("level"))
    r = D.risk(events(spark, sf_dir), ["track_id"]).select("track_id", level.alias("lv"))
    e = D.zone_entries(fixes(spark, sf_dir), zones(spark, sf_dir), CFG, BASE).select("zone_id", "track_id").distinct()
    return e.join(r, "track_id").groupBy("zone_id").agg(F.max("lv").alias("level"), F.count("*").alias("vessels"))


@query("AG38_vessel_flags", "WITH " + WIN + ", v AS (SELECT track_id, bool_or(coalesce(sog_p95 >= 15, false)) AS flagged FROM ft GROUP BY track_id), s AS (SELECT DISTINCT f.track_id, EXISTS (SELECT 1 FROM supplier p WHERE p.s_suppkey = f.user_id AND p.s_acctbal < 0) AS listed FROM fixes f) SELECT flagged, listed, count(*) AS n FROM v JOIN s2 USING (track_id) GROUP BY ALL".replace(", s AS (SELECT DISTINCT f.track_id", ", s2 AS (SELECT DISTINCT f.track_id"))
def vessel_flags(spark, sf_dir):
    """Vessels by whether any window is fast, and whether they are listed."""
    from wakeline.plans.context_queries import listed_flag

    v = window_features(spark, sf_dir).groupBy("track_id").agg(F.bool_or(F.coalesce(F.col("sog_p95") >= 15, F.lit(False))).alias("flagged"))
    return v.join(listed_flag(spark, sf_dir), "track_id").groupBy("flagged", "listed").agg(F.count("*").alias("n"))
