"""Queries of vessel profiles, predicates, sequences and top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo, identity
from wakeline.operators import tracks as T
from wakeline.operators.ranges import percentiles
from wakeline.plans.context_queries import listed_flag
from wakeline.plans.detect_queries import EVENTS, RISK, events
from wakeline.plans.detect_queries import risk as risk_query
from wakeline.plans.registry import haversine, query
from wakeline.plans.track_queries import SEG, WIN, _segments, window_features
from wakeline.sources.fixes import fixes, table

BY = "PARTITION BY track_id ORDER BY t, event_id"


def by_track():
    return W.partitionBy("track_id").orderBy("t", "event_id")


@query("AG18_vessel_index", "SELECT track_id, strftime(min(base_date_time), '%Y-%m-%d') AS first_day, strftime(max(base_date_time), '%Y-%m-%d') AS last_day, count(*) AS n, arg_max(heading, (t, event_id)) FILTER (WHERE heading IS NOT NULL) AS last_heading FROM fixes GROUP BY track_id")
def vessel_index(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    known = F.when(F.col("heading").isNotNull(), F.struct("t", "event_id", "heading"))
    return fixes(spark, sf_dir).groupBy("track_id").agg(day(F.min("base_date_time")).alias("first_day"), day(F.max("base_date_time")).alias("last_day"), F.count("*").alias("n"), F.max(known)["heading"].alias("last_heading"))


@query("AG19_static_profile", "WITH l AS (SELECT *, t - lag(t) OVER p AS dt, " + haversine("lag(latitude) OVER p", "lag(longitude) OVER p", "latitude", "longitude") + f" / 1852 AS nm FROM fixes WINDOW p AS ({BY})) SELECT track_id, round(count(sog) / count(*), 6) AS speed_share, round(avg(sog), 6) AS mean_sog, max(sog) AS max_sog, sum(CASE WHEN nm / greatest(dt, 1) * 3600 >= 60 AND nm >= 4 THEN 1 ELSE 0 END)::BIGINT AS jumps, round(max(dt), 3) AS max_gap FROM l GROUP BY track_id")
def static_profile(spark, sf_dir):
    w = by_track()
    df = T.with_gaps(fixes(spark, sf_dir)).withColumn("nm", geo.haversine_nm(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude")))
    jump = (F.col("nm") / F.greatest("gap", F.lit(1.0)) * 3600 >= 60) & (F.col("nm") >= 4)
    return df.groupBy("track_id").agg(F.round(F.count("sog") / F.count("*"), 6).alias("speed_share"), F.round(F.avg("sog"), 6).alias("mean_sog"), F.max("sog").alias("max_sog"), F.count_if(jump).alias("jumps"), F.round(F.max("gap"), 3).alias("max_gap"))


@query("AG20_presence_profile", "SELECT track_id, count(DISTINCT floor(t / 3600)) AS hours, round((max(t) - min(t)) / 3600, 4) AS span_h, round(avg(latitude), 6) AS mean_lat, round(stddev_samp(latitude), 6) AS std_lat, count(DISTINCT (floor(latitude * 10), floor(longitude * 10))) AS cells FROM fixes GROUP BY track_id")
def presence_profile(spark, sf_dir):
    cells = F.count_distinct(F.struct(F.floor(F.col("latitude") * 10), F.floor(F.col("longitude") * 10)))
    return fixes(spark, sf_dir).groupBy("track_id").agg(F.count_distinct(F.floor(F.col("t") / 3600)).alias("hours"), F.round((F.max("t") - F.min("t")) / 3600, 4).alias("span_h"), F.round(F.avg("latitude"), 6).alias("mean_lat"), F.round(F.stddev_samp("latitude"), 6).alias("std_lat"), cells.alias("cells"))


@query("AG21_type_priors", "WITH v AS (SELECT DISTINCT f.track_id, f.vessel_type, CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = f.user_id AND s.s_acctbal < 0) THEN 1.0e0 ELSE 0.0e0 END AS y FROM fixes f), m AS (SELECT avg(y) AS m FROM v) SELECT vessel_type, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN avg(y) ELSE max(m) END, 6) AS prior, round(CASE WHEN count(*) >= 5 THEN avg(y) ELSE max(m) END / max(m), 6) AS lift FROM v, m GROUP BY vessel_type")
def type_priors(spark, sf_dir):
    """Share of listed vessels by type, the overall share for small groups, and its ratio to the overall share."""
    v = fixes(spark, sf_dir).select("track_id", "vessel_type").distinct().join(listed_flag(spark, sf_dir), "track_id").withColumn("y", F.col("listed").cast("double"))
    whole = v.agg(F.avg("y").alias("m"))
    g = v.groupBy("vessel_type").agg(F.count("*").alias("n"), F.avg("y").alias("y")).crossJoin(F.broadcast(whole))
    prior = F.when(F.col("n") >= 5, F.col("y")).otherwise(F.col("m"))
    return g.select("vessel_type", "n", F.round(prior, 6).alias("prior"), F.round(F.try_divide(prior, F.col("m")), 6).alias("lift"))


@query("AG28_method_choice", "WITH m AS (SELECT l_returnflag || l_linestatus AS method, round(quantile_cont(l_discount, 0.5), 6)::DOUBLE AS overlap FROM lineitem GROUP BY 1), b AS (SELECT *, max(overlap) OVER () AS best FROM m) SELECT method, overlap FROM b WHERE overlap >= best - 0.005 ORDER BY method LIMIT 1", views=False)
def method_choice(spark, sf_dir):
    """The best median, and within a tolerance of it the first by order of preference."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("method"), F.col("l_discount").cast("double").alias("v"))
    m = percentiles(rows, ["method"], "v", {"overlap": 0.5}).withColumn("overlap", F.round("overlap", 6))
    best = m.agg(F.max("overlap").alias("best"))
    return m.crossJoin(F.broadcast(best)).where(F.col("overlap") >= F.col("best") - 0.005).orderBy("method").limit(1).select("method", "overlap")


@query("AG35_fleet_cells", "WITH g AS (SELECT CAST(floor(latitude / 0.25) AS INT) AS ci, CAST(floor(longitude / 0.25) AS INT) AS cj, CAST(floor(t / 86400) AS BIGINT) AS day, count(DISTINCT track_id) AS n FROM fixes GROUP BY ALL), m AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS median FROM g) SELECT ci, cj, day, n, n >= greatest(3, 2 * median) AS unusual FROM g, m")
def fleet_cells(spark, sf_dir):
    """Vessels by cell and day; unusual from twice the upper median, taken over counts of counts."""
    g = fixes(spark, sf_dir).groupBy(geo.cell(F.col("latitude"), 0.25).alias("ci"), geo.cell(F.col("longitude"), 0.25).alias("cj"), F.floor(F.col("t") / 86400).alias("day")).agg(F.count_distinct("track_id").alias("n"))
    sizes = g.groupBy("n").agg(F.count("*").alias("c"))
    upto, total = F.sum("c").over(W.orderBy("n")), F.sum("c").over(W.partitionBy())
    median = sizes.withColumn("ok", upto >= F.floor(total / 2) + 1).where("ok").agg(F.min("n").alias("median"))
    return g.crossJoin(F.broadcast(median)).select("ci", "cj", "day", "n", (F.col("n") >= F.greatest(F.lit(3), 2 * F.col("median"))).alias("unusual"))


@query("AG39_history_summary", "WITH g AS (SELECT track_id, count(DISTINCT floor(t / 86400)) AS days, count(*) AS n FROM fixes GROUP BY track_id) SELECT track_id, days, n, CASE WHEN days >= 27 AND n >= 70 THEN 'HIGH' WHEN days >= 20 AND n >= 50 THEN 'MEDIUM' ELSE 'unknown' END AS confidence, concat_ws('; ', CASE WHEN days < 20 THEN 'too few days' END, CASE WHEN n < 50 THEN 'too few reports' END) AS reasons FROM g")
def history_summary(spark, sf_dir):
    g = fixes(spark, sf_dir).groupBy("track_id").agg(F.count_distinct(F.floor(F.col("t") / 86400)).alias("days"), F.count("*").alias("n"))
    level = F.when((F.col("days") >= 27) & (F.col("n") >= 70), "HIGH").when((F.col("days") >= 20) & (F.col("n") >= 50), "MEDIUM").otherwise("unknown")
    return g.select("track_id", "days", "n", level.alias("confidence"), F.concat_ws("; ", F.when(F.col("days") < 20, "too few days"), F.when(F.col("n") < 50, "too few reports")).alias("reasons"))


@query("AG40_diagnostics", "WITH g AS (SELECT track_id, count(*) AS n, count(sog) AS s FROM fixes GROUP BY track_id) SELECT sum(n)::BIGINT AS considered, sum(s)::BIGINT AS joinable, sum(n - s)::BIGINT AS excluded, count(*) AS vessels, sum(CASE WHEN n >= 70 THEN 1 ELSE 0 END)::BIGINT AS sufficient FROM g")
def diagnostics(spark, sf_dir):
    g = fixes(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("n"), F.count("sog").alias("s"))
    return g.agg(F.sum("n").alias("considered"), F.sum("s").alias("joinable"), F.sum(F.col("n") - F.col("s")).alias("excluded"), F.count("*").alias("vessels"), F.count_if(F.col("n") >= 70).alias("sufficient"))


@query("AG46_sample_percentiles", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6)::DOUBLE AS p50, round(quantile_cont(value, 0.95), 6)::DOUBLE AS p95, round(max(value), 6)::DOUBLE AS most FROM events GROUP BY event_type", views=False)
def sample_percentiles(spark, sf_dir):
    """Median, 95th percentile and maximum of measured samples by kind."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(v).alias("n"), *[F.round(x, 6).cast("double").alias(k) for k, x in (("p50", F.percentile(v, 0.5)), ("p95", F.percentile(v, 0.95)), ("most", F.max(v)))])


CATEGORY = "CASE WHEN vessel_type IN (31, 32, 52) THEN 'tug' WHEN vessel_type IN (36, 37) THEN 'pleasure' WHEN vessel_type = 30 THEN 'fishing' WHEN vessel_type BETWEEN 60 AND 69 THEN 'passenger' WHEN vessel_type BETWEEN 70 AND 79 THEN 'cargo' WHEN vessel_type BETWEEN 80 AND 89 THEN 'tanker' ELSE 'other' END"


@query("F13_ship_category", f"SELECT DISTINCT vessel_type, {CATEGORY} AS category FROM (SELECT vessel_type FROM fixes UNION ALL SELECT vessel_type - 40 FROM fixes)")
def ship_category(spark, sf_dir):
    f = fixes(spark, sf_dir).select("vessel_type")
    both = f.union(f.select(F.col("vessel_type") - 40)).distinct()
    return both.select("vessel_type", identity.ship_category(F.col("vessel_type")).alias("category"))


@query("AG48_category_counts", f"WITH c AS (SELECT DISTINCT track_id, {CATEGORY} AS category FROM fixes) SELECT category, count(*) AS n FROM c GROUP BY category")
def category_counts(spark, sf_dir):
    c = fixes(spark, sf_dir).select("track_id", identity.ship_category(F.col("vessel_type")).alias("category")).distinct()
    return c.groupBy("category").agg(F.count("*").alias("n"))


@query("AG55_one_per_hull", "WITH n AS (SELECT track_id, vessel_type, user_id % 40 AS hull, count(*) AS n FROM fixes GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY hull ORDER BY n DESC, track_id) AS r FROM n) SELECT hull, track_id, n FROM r WHERE r = 1")
def one_per_hull(spark, sf_dir):
    n = fixes(spark, sf_dir).groupBy("track_id", (F.col("user_id") % 40).alias("hull")).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("hull").orderBy(F.desc("n"), "track_id"))).where("r = 1").drop("r")


@query("F22_history_split", "WITH c AS (SELECT track_id, sum(CASE WHEN t < 1705276800 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN t >= 1705276800 THEN 1 ELSE 0 END) AS l FROM fixes GROUP BY track_id) SELECT CASE WHEN t < 1705276800 THEN 'history' ELSE 'live' END AS side, count(*) AS n, count(DISTINCT track_id) AS vessels FROM fixes JOIN c USING (track_id) WHERE CASE WHEN t < 1705276800 THEN h >= 30 ELSE l >= 35 END GROUP BY ALL")
def history_split(spark, sf_dir):
    """Reports before and after a cut, each side with its own least number per vessel."""
    old = F.col("t") < 1705276800
    df = fixes(spark, sf_dir).withColumn("side", F.when(old, "history").otherwise("live"))
    df = df.withColumn("c", F.count("*").over(W.partitionBy("track_id", "side"))).where(F.col("c") >= F.when(old, 30).otherwise(35))
    return df.groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("vessels"))


@query("F23_eligibility", "WITH s AS (SELECT track_id, count(*) AS n, max(t) - min(t) AS span, count(sog) / count(*) AS sf FROM fixes GROUP BY track_id), r AS (SELECT * FROM (VALUES ('gaps', 60, 2400000, 0.0e0), ('loitering', 70, 2400000, 0.8e0), ('pattern', 80, 2500000, 0.5e0)) v(kind, min_n, min_span, min_sf)) SELECT track_id, kind, CASE WHEN n < min_n THEN 'too few reports' WHEN span < min_span THEN 'too short' WHEN sf < min_sf THEN 'speed missing' ELSE 'eligible' END AS status FROM s, r")
def eligibility(spark, sf_dir):
    """Each vessel against each detector's needs, with the first that fails."""
    needs = (("gaps", 60, 2_400_000, 0.0), ("loitering", 70, 2_400_000, 0.8), ("pattern", 80, 2_500_000, 0.5))
    s = fixes(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), (F.count("sog") / F.count("*")).alias("sf"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(F.col("n") < a, "too few reports").when(F.col("span") < b, "too short").when(F.col("sf") < c, "speed missing").otherwise("eligible").alias("status")) for k, a, b, c in needs])
    return s.select("track_id", F.inline(rows))


@query("F25_near_edge", "SELECT event_id, (latitude - 21.8e0) * 60 < 12 OR (26.2e0 - latitude) * 60 < 12 OR (longitude - 118.5e0) * 60 * greatest(0.2e0, cos(radians(latitude))) < 12 OR (122.9e0 - longitude) * 60 * greatest(0.2e0, cos(radians(latitude))) < 12 AS near_edge FROM fixes")
def near_edge(spark, sf_dir):
    lat, lon = F.col("latitude"), F.col("longitude")
    k = 60 * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    near = ((lat - 21.8) * 60 < 12) | ((26.2 - lat) * 60 < 12) | ((lon - 118.5) * k < 12) | ((122.9 - lon) * k < 12)
    return fixes(spark, sf_dir).select("event_id", near.alias("near_edge"))


@query("F26_berthed", "SELECT track_id, count(*) >= 6 AND max(t) - min(t) >= 21600 AND (max(latitude) - min(latitude)) * 60 <= 23.9 AS berthed FROM fixes GROUP BY track_id")
def berthed(spark, sf_dir):
    still = (F.max("latitude") - F.min("latitude")) * 60 <= 23.9
    return fixes(spark, sf_dir).groupBy("track_id").agg(((F.count("*") >= 6) & (F.max("t") - F.min("t") >= 21600) & still).alias("berthed"))


@query("F27_static_fraction", "WITH " + SEG + " SELECT segment_id, round(avg(CASE WHEN status IN (1, 5, 6) THEN 1.0e0 ELSE 0.0e0 END), 6) AS static_fraction FROM seg GROUP BY segment_id")
def static_fraction(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("segment_id").agg(F.round(F.avg(F.col("status").isin(1, 5, 6).cast("double")), 6).alias("static_fraction"))


@query("WN6_slow_runs", f"WITH x AS (SELECT *, sum(CASE WHEN coalesce(sog < 6, false) THEN 0 ELSE 1 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS run FROM fixes) SELECT track_id, run::BIGINT AS run, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM x WHERE sog < 6 GROUP BY track_id, run")
def slow_runs(spark, sf_dir):
    runs = T.islands(fixes(spark, sf_dir), F.col("sog") < 6, ["track_id"], ["t", "event_id"])
    return runs.groupBy("track_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("WN7_split_runs", f"WITH s AS (SELECT * FROM fixes WHERE sog < 6), g AS (SELECT *, CASE WHEN t - lag(t) OVER ({BY}) <= 86400 THEN 0 ELSE 1 END AS k FROM s), r AS (SELECT *, sum(k) OVER ({BY} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM g) SELECT track_id, run, count(*) AS n, round(max(t) - min(t), 3) AS span FROM r GROUP BY track_id, run")
def split_runs(spark, sf_dir):
    """Slow reports in runs that end where the next slow one is over a day later."""
    s = fixes(spark, sf_dir).where("sog < 6")
    k = F.coalesce(F.col("t") - F.lag("t").over(by_track()) > 86400, F.lit(True)).cast("int")
    s = s.withColumn("k", k).withColumn("run", F.sum("k").over(by_track().rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("track_id", "run").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("span"))


@query("WN8_episodes", "WITH " + WIN + ", fl AS (SELECT track_id, ws AS a, ws + 432000 AS z, sog_p95 FROM ft WHERE sog_p95 >= 19), eg AS (SELECT *, CASE WHEN a <= lag(z) OVER (PARTITION BY track_id ORDER BY a, z) + 10800 THEN 0 ELSE 1 END AS e FROM fl), er AS (SELECT *, sum(e) OVER (PARTITION BY track_id ORDER BY a, z ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM eg) SELECT track_id, episode, count(*) AS n, round(max(z) - min(a), 3) AS span, round(avg(sog_p95), 5) AS mean_p95 FROM er GROUP BY track_id, episode")
def episodes(spark, sf_dir):
    """Fast windows of a vessel merged when one starts within three hours of the end of the one before."""
    f = window_features(spark, sf_dir).where("sog_p95 >= 19").select("track_id", F.col("window_start").alias("a"), (F.col("window_start") + 432000).alias("z"), "sog_p95")
    w = W.partitionBy("track_id").orderBy("a", "z")
    f = f.withColumn("e", F.coalesce(F.col("a") > F.lag("z").over(w) + 10800, F.lit(True)).cast("int")).withColumn("episode", F.sum("e").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return f.groupBy("track_id", "episode").agg(F.count("*").alias("n"), F.round(F.max("z") - F.min("a"), 3).alias("span"), (F.round(F.avg("sog_p95") * 1e5) / 1e5).alias("mean_p95"))


@query("WN16_status_toggles", f"WITH c AS (SELECT *, status < 4 AS moving FROM fixes), b AS (SELECT *, CASE WHEN moving = lag(moving) OVER ({BY}) THEN 0 ELSE 1 END AS k FROM c), r AS (SELECT *, sum(k) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS run FROM b), g AS (SELECT track_id, run, bool_or(moving) AS moving, count(*) AS n FROM r GROUP BY track_id, run), s AS (SELECT *, lag(n) OVER p AS b, lead(n) OVER p AS a FROM g WINDOW p AS (PARTITION BY track_id ORDER BY run)) SELECT track_id, sum(CASE WHEN NOT moving AND n <= 2 AND b >= 2 AND a >= 2 THEN 1 ELSE 0 END)::BIGINT AS toggles FROM s GROUP BY track_id")
def status_toggles(spark, sf_dir):
    """Short departures from a steady status and back: run lengths, with the runs around."""
    df = fixes(spark, sf_dir).withColumn("moving", F.col("status") < 4)
    k = F.coalesce(F.col("moving") != F.lag("moving").over(by_track()), F.lit(True)).cast("int")
    df = df.withColumn("k", k).withColumn("run", F.sum("k").over(by_track().rowsBetween(W.unboundedPreceding, 0)))
    g = df.groupBy("track_id", "run").agg(F.bool_or("moving").alias("moving"), F.count("*").alias("n"))
    w = W.partitionBy("track_id").orderBy("run")
    short = ~F.col("moving") & (F.col("n") <= 2) & (F.lag("n").over(w) >= 2) & (F.lead("n").over(w) >= 2)
    return g.withColumn("x", F.coalesce(short, F.lit(False))).groupBy("track_id").agg(F.count_if("x").alias("toggles"))


@query("WN19_top_per_track", "WITH " + WIN + ", o AS (SELECT track_id, segment_id, window_ordinal, round(path_m, 3) AS p FROM ft WHERE path_m IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY p DESC, segment_id, window_ordinal) AS r FROM o), q AS (SELECT *, row_number() OVER (ORDER BY p DESC, track_id) AS place FROM r WHERE r = 1) SELECT track_id, segment_id, window_ordinal, place FROM q WHERE place BETWEEN 11 AND 30".replace(", o AS (", ", tt AS (").replace("FROM o)", "FROM tt)").replace(", q AS (SELECT *, row_number() OVER (ORDER", ", pg AS (SELECT *, row_number() OVER (ORDER").replace("FROM q WHERE place", "FROM pg WHERE place"))
def top_per_track(spark, sf_dir):
    """The longest window of each track, and the second page of them."""
    f = window_features(spark, sf_dir).where("path_m is not null").withColumn("p", F.round("path_m", 3))
    top = f.withColumn("r", F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("p"), "segment_id", "window_ordinal"))).where("r = 1")
    page = top.orderBy(F.desc("p"), "track_id").limit(30)
    return page.withColumn("place", F.row_number().over(W.orderBy(F.desc("p"), "track_id")).cast("long")).where("place > 10").select("track_id", "segment_id", "window_ordinal", "place")


@query("WN20_detection_time", EVENTS + " SELECT kind, count(*) AS n, round(min(CASE kind WHEN 'ais_gap' THEN t0 + 86400 WHEN 'zone_entry' THEN t0 ELSE t1 END), 3) AS first_known FROM ev GROUP BY kind")
def detection_time(spark, sf_dir):
    known = F.when(F.col("kind") == "ais_gap", F.col("t0") + 86400).when(F.col("kind") == "zone_entry", F.col("t0")).otherwise(F.col("t1"))
    return events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.min(known), 3).alias("first_known"))


@query("WN23_trails", "WITH m AS (SELECT track_id, max(t) AS m FROM fixes GROUP BY track_id), p AS (SELECT f.* FROM fixes f JOIN m USING (track_id) WHERE m.m - f.t <= 50400) SELECT track_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t, event_id) AS trail, count(*) AS n FROM p GROUP BY track_id HAVING count(*) >= 2")
def trails(spark, sf_dir):
    """Points of each vessel's last 14 hours in order, two at least."""
    p = fixes(spark, sf_dir).withColumn("m", F.max("t").over(W.partitionBy("track_id"))).where(F.col("m") - F.col("t") <= 50400)
    g = p.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("x")).where(F.size("x") >= 2)
    return g.select("track_id", F.array_join(F.transform("x", lambda s: s["event_id"].cast("string")), ",").alias("trail"), F.size("x").cast("long").alias("n"))


@query("SO5_map_sample", EVENTS + RISK + ", hi AS (SELECT track_id FROM rk WHERE round(risk, 6) >= 88), n AS (SELECT track_id, count(*) AS n FROM fixes GROUP BY track_id), o AS (SELECT track_id, n, track_id IN (SELECT track_id FROM hi) AS alert FROM n), r AS (SELECT *, row_number() OVER (ORDER BY alert DESC, n DESC, track_id) AS place FROM o) SELECT track_id, alert, place FROM r WHERE place <= 40")
def map_sample(spark, sf_dir):
    """Alerted vessels first, then the longest tracks, forty in all."""
    hi = risk_query(spark, sf_dir).where("risk >= 88").select("track_id", F.lit(True).alias("alert"))
    n = fixes(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("n")).join(hi, "track_id", "left").withColumn("alert", F.coalesce("alert", F.lit(False)))
    order = (F.desc("alert"), F.desc("n"), F.asc("track_id"))
    return n.orderBy(*order).limit(40).withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long")).select("track_id", "alert", "place")


@query("SO7_decimated_path", f"WITH x AS (SELECT *, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM fixes) SELECT track_id, event_id FROM x WHERE i % greatest(1, n // 40) = 0")
def decimated_path(spark, sf_dir):
    x = fixes(spark, sf_dir).withColumns({"i": F.row_number().over(by_track()) - 1, "n": F.count("*").over(W.partitionBy("track_id"))})
    return x.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / 40)) == 0).select("track_id", "event_id")


@query("SE4_track_days", "SELECT DISTINCT track_id, strftime(base_date_time, '%Y-%m-%d') AS day FROM fixes")
def track_days(spark, sf_dir):
    return fixes(spark, sf_dir).select("track_id", F.date_format("base_date_time", "yyyy-MM-dd").alias("day")).distinct()


@query("SC12_duration_text", f"WITH l AS (SELECT event_id, t - lag(t) OVER ({BY}) AS g FROM fixes), m AS (SELECT event_id, CAST(floor(g / 60) AS BIGINT) AS m FROM l WHERE g IS NOT NULL) SELECT event_id, CASE WHEN m < 60 THEN m || ' min' WHEN m < 2880 THEN (m // 60) || ' h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || ' min' ELSE (m // 1440) || ' d' END AS text FROM m")
def duration_text(spark, sf_dir):
    m = T.with_gaps(fixes(spark, sf_dir)).where("gap is not null").select("event_id", F.floor(F.col("gap") / 60).alias("m"))
    h = F.format_string("%d h %02d min", F.floor(F.col("m") / 60), F.col("m") % 60)
    return m.select("event_id", F.when(F.col("m") < 60, F.format_string("%d min", "m")).when(F.col("m") < 2880, h).otherwise(F.format_string("%d d", F.floor(F.col("m") / 1440))).alias("text"))


@query("SC15_ordinary_z", "WITH s AS (SELECT track_id, avg(sog) AS m, stddev_pop(sog) AS s FROM fixes GROUP BY track_id) SELECT event_id, round((sog - m) / nullif(s, 0), 5) AS z FROM fixes JOIN s USING (track_id) WHERE sog IS NOT NULL")
def ordinary_z(spark, sf_dir):
    w = W.partitionBy("track_id")
    z = (F.col("sog") - F.avg("sog").over(w)) / F.nullif(F.stddev_pop("sog").over(w), F.lit(0.0))
    return fixes(spark, sf_dir).select("event_id", "sog", F.round(z, 5).alias("z")).where("sog is not null").select("event_id", "z")


@query("SC16_short_ids", "SELECT DISTINCT track_id, substr(sha256(track_id || '|alert'), 1, 12) AS alert_id, substr(sha1(track_id), 1, 10) AS area_id FROM fixes")
def short_ids(spark, sf_dir):
    v = fixes(spark, sf_dir).select("track_id").distinct()
    return v.select("track_id", F.substring(F.sha2(F.concat("track_id", F.lit("|alert")), 256), 1, 12).alias("alert_id"), F.substring(F.sha1("track_id"), 1, 10).alias("area_id"))


@query("J15_nearest_report", "WITH g AS (SELECT track_id, unnest(range(19723, 19753)) * 86400.0e0 AS m FROM (SELECT DISTINCT track_id FROM fixes)), d AS (SELECT g.track_id, g.m, f.event_id, abs(f.t - g.m) AS d, f.t FROM g JOIN fixes f ON f.track_id = g.track_id AND abs(f.t - g.m) <= 43200), r AS (SELECT *, row_number() OVER (PARTITION BY track_id, m ORDER BY d, t, event_id) AS r FROM d) SELECT track_id, CAST(m AS BIGINT) AS midnight, event_id FROM r WHERE r = 1")
def nearest_report(spark, sf_dir):
    """The report nearest to each midnight within half a day, the earlier of equal ones: every report names its midnight by rounding."""
    df = fixes(spark, sf_dir).withColumn("at", F.floor(F.col("t") / 86400 + 0.5) * 86400)
    df = df.where(F.col("at").between(19723 * 86400, 19752 * 86400)).withColumn("d", F.abs(F.col("t") - F.col("at")))
    r = F.row_number().over(W.partitionBy("track_id", "at").orderBy("d", "t", "event_id"))
    return df.withColumn("r", r).where("r = 1").select("track_id", F.col("at").cast("long").alias("midnight"), "event_id")


@query("J27_unique_identity", "WITH c AS (SELECT o_custkey % 1400 AS mmsi, o_custkey AS vessel, count(*) AS n FROM orders GROUP BY ALL), u AS (SELECT mmsi FROM c GROUP BY mmsi HAVING count(*) = 1) SELECT c.mmsi, c.vessel, c.n FROM c JOIN u USING (mmsi)", views=False)
def unique_identity(spark, sf_dir):
    """Look-ups by an identity only where it belongs to exactly one vessel."""
    c = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 1400).alias("mmsi"), F.col("o_custkey").alias("vessel")).agg(F.count("*").alias("n"))
    return c.withColumn("k", F.count("*").over(W.partitionBy("mmsi"))).where("k = 1").select("mmsi", "vessel", "n")


@query("J30_supply_routes", "SELECT n_name AS port, count(*) AS routes, sum(l_quantity)::BIGINT AS units, count(DISTINCT o_orderkey) AS demands FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY n_name", views=False)
def supply_routes(spark, sf_dir):
    """Routes, units and demands by port, without the ports of a disrupted region."""
    nation = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("port"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(nation, "s_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(supplier, "l_suppkey").join(orders, "l_orderkey")
    return lines.groupBy("port").agg(F.count("*").alias("routes"), F.sum("l_quantity").cast("long").alias("units"), F.count_distinct("l_orderkey").alias("demands"))
