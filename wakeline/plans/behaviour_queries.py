"""Queries of behaviours that need other vessels or learned context: meetings, off-route travel, dark meetings, slow work on cables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.operators import context as C
from wakeline.operators import detect as D
from wakeline.operators import encounters as E
from wakeline.operators import joins as J
from wakeline.operators import tracks as T
from wakeline.plans.context_queries import CELLS, PAIRS, STEP, steps
from wakeline.plans.detect_queries import CFG, GAPS
from wakeline.plans.registry import haversine, query
from wakeline.sources.fixes import fixes, zones

MEET = PAIRS + ", ms AS (SELECT step, track_id, track_id2, nm FROM pr WHERE nm <= 6 AND coalesce(sog, 0) <= 10 AND coalesce(sog2, 0) <= 10), mg AS (SELECT *, CASE WHEN step - lag(step) OVER p <= 2 THEN 0 ELSE 1 END AS b FROM ms WINDOW p AS (PARTITION BY track_id, track_id2 ORDER BY step)), mr AS (SELECT *, sum(b) OVER (PARTITION BY track_id, track_id2 ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM mg), me AS (SELECT track_id, track_id2, min(step) * 21600.0e0 AS t0, (max(step) + 1) * 21600.0e0 AS t1, count(*) AS steps, avg(nm) AS nm FROM mr GROUP BY track_id, track_id2, run HAVING count(*) >= 0.6 * (max(step) - min(step) + 1))"


def slow_steps(spark, sf_dir):
    return steps(spark, sf_dir).where(F.coalesce("sog", F.lit(0.0)) <= 10)


def meetings(spark, sf_dir):
    """(track_id, track_id2, t0, t1, steps, nm, severity): slow pairs over steps, one missing step tolerated."""
    g = E.encounters(slow_steps(spark, sf_dir), 6.0)
    t0, t1 = F.col("k0") * STEP, (F.col("k1") + 1) * STEP
    sev = 45 + 25 * F.least(F.lit(1.0), ((t1 - t0) / 60 - 360) / 720)
    return g.select("track_id", "track_id2", t0.alias("t0"), t1.alias("t1"), "steps", "nm", "latitude", "longitude", D.clip(sev).alias("severity"))


@query("D3_meetings", "WITH " + MEET + " SELECT track_id, track_id2, t0, t1, steps, round(nm, 6) AS nm, round(45 + 25 * least(1, ((t1 - t0) / 60 - 360) / 720), 6) AS severity FROM me")
def meetings_query(spark, sf_dir):
    return meetings(spark, sf_dir).select("track_id", "track_id2", "t0", "t1", "steps", F.round("nm", 6).alias("nm"), F.round("severity", 6).alias("severity"))


FAMILIAR = CELLS + ", of AS (SELECT unnest([-1, 0, 1]) AS d), fa AS (SELECT ci + a.d AS ci, cj + b.d AS cj, sum(vessels) / 4.0e0 AS f FROM cells, of a, of b GROUP BY ALL), od AS (SELECT x.*, coalesce(f, 0) < 5 AND coalesce(sog, 0) >= 3 AS odd FROM fixes x LEFT JOIN fa ON fa.ci = floor(latitude / 0.5) AND fa.cj = floor(longitude / 0.5)), oq AS (SELECT *, sum(CASE WHEN odd THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM od)"


@query("D8_unfamiliar_water", "WITH " + FAMILIAR + " SELECT track_id, run, count(*) AS n, round(min(t), 3) AS t0, round(max(t), 3) AS t1 FROM oq WHERE odd GROUP BY track_id, run")
def unfamiliar_water(spark, sf_dir):
    """Runs of reports under way in cells that few vessels use."""
    df = fixes(spark, sf_dir)
    known = C.familiarity(C.traffic_cells(df))
    x = df.withColumns({"ci": geo.cell(F.col("latitude"), 0.5), "cj": geo.cell(F.col("longitude"), 0.5)}).join(known, ["ci", "cj"], "left")
    odd = (F.coalesce("familiarity", F.lit(0.0)) < 5) & (F.coalesce("sog", F.lit(0.0)) >= 3)
    g = T.islands(x, odd, ["track_id"], ["t", "event_id"]).groupBy("track_id", "run")
    return g.agg(F.count("*").alias("n"), F.round(F.min("t"), 3).alias("t0"), F.round(F.max("t"), 3).alias("t1"))


@query("D12_cable_work", "WITH cb AS (SELECT f.*, z.zone_id FROM fixes f JOIN zones z ON z.kind = 'cable' AND abs(f.longitude - z.lon_c) <= z.half_deg AND abs(f.latitude - z.lat_c) <= z.half_deg WHERE coalesce(f.sog, 0) <= 10), cg AS (SELECT *, CASE WHEN t - lag(t) OVER p <= 172800 THEN 0 ELSE 1 END AS k FROM cb WINDOW p AS (PARTITION BY track_id, zone_id ORDER BY t, event_id)), cr AS (SELECT *, sum(k) OVER (PARTITION BY track_id, zone_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM cg) SELECT track_id, zone_id, run, count(*) AS n, round(max(t) - min(t), 3) AS span FROM cr GROUP BY ALL")
def cable_work(spark, sf_dir):
    """Slow reports on a cable's corridor, in runs that end where the next one is over two days later."""
    slow = fixes(spark, sf_dir).where(F.coalesce("sog", F.lit(0.0)) <= 10)
    on = J.in_squares(slow, zones(spark, sf_dir).where("kind = 'cable'"))
    w = W.partitionBy("track_id", "zone_id").orderBy("t", "event_id")
    on = on.withColumn("k", F.coalesce(F.col("t") - F.lag("t").over(w) > 172_800, F.lit(True)).cast("int")).withColumn("run", F.sum("k").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return on.groupBy("track_id", "zone_id", "run").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("span"))


@query("J21_dark_meetings", "WITH " + GAPS + ", " + MEET + ", st AS (SELECT track_id AS v, track_id2 AS v2, t0 AS s0, t1 AS s1 FROM me)".replace(", st AS", ", sx AS") + ", dk AS (SELECT ga.event_id, ga.track_id, v, v2, least(ga.t1, s1) - greatest(ga.t0, s0) AS overlap, (least(ga.t1, s1) - greatest(ga.t0, s0)) / (s1 - s0) AS frac FROM ga JOIN sx ON ga.t0 <= s1 AND ga.t1 >= s0 AND ga.track_id <> v AND ga.track_id <> v2 WHERE NOT ga.stationary), dr AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(frac, 6) DESC, overlap DESC, v, v2) AS r FROM dk WHERE overlap >= 1200 AND frac >= 0.6) SELECT event_id, track_id, v, v2, round(overlap, 3) AS overlap FROM dr WHERE r = 1")
def dark_meetings(spark, sf_dir):
    """For each silence, the meeting of two other vessels that it covers best.

    Of the meetings with the same start and end only three can count, so silences meet spans of steps, not meetings.
    """
    g = D.gaps(fixes(spark, sf_dir), CFG).where("not stationary").select("event_id", "track_id", F.col("t0").alias("g0"), F.col("t1").alias("g1"), F.lit(0).alias("k"))
    m = E.best_of_spans(slow_steps(spark, sf_dir), 6.0)
    m = m.select(F.col("track_id").alias("v"), F.col("track_id2").alias("v2"), (F.col("k0") * STEP).alias("s0"), ((F.col("k1") + 1) * STEP).alias("s1"), F.lit(0).alias("k"))
    both = J.overlap_join(g, m, ["k"], ("g0", "g1"), ("s0", "s1"), 86_400.0).where("track_id <> v and track_id <> v2")
    overlap = F.least("g1", "s1") - F.greatest("g0", "s0")
    both = both.withColumn("overlap", overlap).withColumn("frac", F.col("overlap") / (F.col("s1") - F.col("s0"))).where("overlap >= 1200 and frac >= 0.6")
    best = F.min(F.struct((-F.round("frac", 6)).alias("f"), (-F.col("overlap")).alias("o"), "v", "v2")).alias("b")
    return both.groupBy("event_id", "track_id").agg(best).select("event_id", "track_id", "b.v", "b.v2", F.round(-F.col("b.o"), 3).alias("overlap"))


@query("WN22_positions_at", "WITH c AS (SELECT track_id, max(t) AS last FROM fixes GROUP BY track_id), s AS (SELECT f.*, row_number() OVER (PARTITION BY track_id ORDER BY t DESC, event_id DESC) AS r FROM fixes f WHERE t <= 1705665600) SELECT s.track_id, s.event_id, round(" + haversine("s.latitude", "s.longitude", "24.0e0", "120.5e0") + " / 1852, 5) AS nm FROM s JOIN c USING (track_id) WHERE r = 1 AND 1705665600 - s.t <= 86400 AND 1705665600 <= c.last + 1800")
def positions_at(spark, sf_dir):
    """Where each vessel is at a time: its last report, not too old, unless its track has ended."""
    at = 1705665600
    df = fixes(spark, sf_dir).withColumn("last", F.max("t").over(W.partitionBy("track_id"))).where(F.col("t") <= at)
    r = F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("t"), F.desc("event_id")))
    df = df.withColumn("r", r).where((F.col("r") == 1) & (at - F.col("t") <= 86_400) & (F.lit(at) <= F.col("last") + 1800))
    return df.select("track_id", "event_id", F.round(geo.haversine_nm(F.col("latitude"), F.col("longitude"), F.lit(24.0), F.lit(120.5)), 5).alias("nm"))


ROUTE = "rl AS (SELECT *, lag(latitude) OVER p AS la, lag(longitude) OVER p AS lo, coalesce(" + haversine("lag(latitude) OVER p", "lag(longitude) OVER p", "latitude", "longitude") + " / 1852, 0) AS d FROM fixes WINDOW p AS (PARTITION BY track_id ORDER BY t, event_id)), rs AS (SELECT *, sum(d) OVER (PARTITION BY track_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s, sum(d) OVER (PARTITION BY track_id) AS total FROM rl), ri AS (SELECT *, CASE WHEN la IS NULL THEN 0 ELSE CAST(floor((s - d) / total * 19 + 1e-9) AS BIGINT) + 1 END AS i, CASE WHEN la IS NULL THEN 0 ELSE least(19, CAST(floor(s / total * 19 + 1e-9) AS BIGINT)) END AS j FROM rs WHERE total > 0), ra AS (SELECT *, unnest(range(i, j + 1)) AS anchor FROM ri WHERE j >= i), rp AS (SELECT track_id, vessel_type, anchor, CASE WHEN la IS NULL THEN latitude ELSE la + CASE WHEN d > 0 THEN (anchor / 19.0e0 * total - (s - d)) / d ELSE 1 END * (latitude - la) END AS y, CASE WHEN la IS NULL THEN longitude ELSE lo + CASE WHEN d > 0 THEN (anchor / 19.0e0 * total - (s - d)) / d ELSE 1 END * (longitude - lo) END AS x FROM ra)"


@query("WN11_resampled_routes", "WITH " + ROUTE + " SELECT track_id, anchor, round(y, 5) AS latitude, round(x, 5) AS longitude FROM rp")
def resampled_routes(spark, sf_dir):
    from wakeline.operators import routes

    out = routes.resample(fixes(spark, sf_dir))
    return out.select("track_id", "anchor", F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"))


@query("AG29_route_corridors", "WITH " + ROUTE + ", rm AS (SELECT vessel_type % 10 AS route, anchor, quantile_cont(y, 0.5) AS my, quantile_cont(x, 0.5) AS mx, count(*) AS tracks FROM rp GROUP BY ALL HAVING count(*) >= 5) SELECT route, rp.anchor, round(max(my), 5) AS latitude, round(max(mx), 5) AS longitude, round(greatest(quantile_cont(" + haversine("y", "x", "my", "mx") + ", 0.9), 100), 2) AS width_m, max(tracks) AS tracks FROM rp JOIN rm ON rm.route = rp.vessel_type % 10 AND rm.anchor = rp.anchor GROUP BY route, rp.anchor")
def route_corridors(spark, sf_dir):
    """Centre line and width of the tracks of each group of vessel types."""
    from wakeline.operators import routes

    f = fixes(spark, sf_dir)
    group = f.select("track_id", (F.col("vessel_type") % 10).alias("route")).distinct()
    out = routes.corridor(routes.resample(f).join(group, "track_id"), "route")
    return out.select("route", "anchor", *[F.round(c, 5).alias(c) for c in ("latitude", "longitude")], F.round("width_m", 2).alias("width_m"), "tracks")
