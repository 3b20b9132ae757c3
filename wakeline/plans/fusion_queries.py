"""Queries that put scores, labels, events and resources together."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.operators import detect as D
from wakeline.operators import joins as J
from wakeline.operators import ranking as R
from wakeline.plans.context_queries import TRUTH, listed_flag, truth
from wakeline.plans.detect_queries import EVENTS, RISK, events
from wakeline.plans.ranking_queries import SCORE, scores
from wakeline.plans.registry import haversine, query
from wakeline.plans.track_queries import WIN, window_features
from wakeline.sources.fixes import fixes, table

BY = "PARTITION BY track_id ORDER BY t, event_id"
LISTED = "ls0 AS (SELECT DISTINCT f.track_id, EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = f.user_id AND s.s_acctbal < 0) AS listed FROM fixes f)"


@query("AG24_shortlist_shares", SCORE + ", z AS (SELECT *, round(score, 9) AS rs FROM sc), kk AS (SELECT segment_id, row_number() OVER (ORDER BY rs DESC, segment_id, window_ordinal) AS rank FROM z), tk AS (SELECT split_part(segment_id, ':', 1) AS track_id, count(*) AS n FROM kk WHERE rank <= 50 GROUP BY 1) SELECT count(*) AS tracks, sum(n)::BIGINT AS windows, round(max(n) / sum(n), 6) AS max_share, count(*) >= 10 AND max(n) / sum(n) <= 0.2 AS eligible FROM tk")
def shortlist_shares(spark, sf_dir):
    ranked = R.rank(scores(spark, sf_dir).withColumn("score", F.round("score", 9)), "score", ["segment_id", "window_ordinal"], 50, keep=50).where("shortlisted")
    n = ranked.groupBy(F.split_part("segment_id", F.lit(":"), F.lit(1)).alias("track_id")).agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return n.agg(F.count("*").alias("tracks"), F.sum("n").alias("windows"), F.round(share, 6).alias("max_share"), ((F.count("*") >= 10) & (share <= 0.2)).alias("eligible"))


@query("AG30_declared_role", "WITH s AS (SELECT track_id, max(CASE WHEN vessel_type IN (80, 81) THEN 0.5e0 ELSE 0 END) AS a, avg(CASE WHEN status = 3 THEN 1.0e0 ELSE 0 END) AS b, avg(CASE WHEN status IN (1, 5, 6) THEN 1.0e0 ELSE 0 END) AS c FROM fixes GROUP BY track_id) SELECT track_id, round(1 - (1 - a) * (1 - least(0.6e0, 2 * b)) * (1 - 0.3e0 * c), 6) AS score, CASE WHEN b >= 0.15 THEN 'restricted' WHEN c >= 0.4 THEN 'at_rest' ELSE 'under_way' END AS state FROM s")
def declared_role(spark, sf_dir):
    """Noisy-or of what a vessel declares: its class, restricted manoeuvring, and rest."""
    share = lambda cond: F.avg(cond.cast("double"))
    s = fixes(spark, sf_dir).groupBy("track_id").agg(F.max(F.when(F.col("vessel_type").isin(80, 81), 0.5).otherwise(0.0)).alias("a"), share(F.col("status") == 3).alias("b"), share(F.col("status").isin(*D.STATIC)).alias("c"))
    score = 1 - (1 - F.col("a")) * (1 - F.least(F.lit(0.6), 2 * F.col("b"))) * (1 - 0.3 * F.col("c"))
    return s.select("track_id", F.round(score, 6).alias("score"), F.when(F.col("b") >= 0.15, "restricted").when(F.col("c") >= 0.4, "at_rest").otherwise("under_way").alias("state"))


@query("AG32_factor_table", "WITH " + LISTED + ", f AS (SELECT f.event_id, EXISTS (SELECT 1 FROM zones z WHERE abs(f.longitude - z.lon_c) <= z.half_deg AND abs(f.latitude - z.lat_c) <= z.half_deg) AS in_zone, coalesce(sog, 0) < 6 AS slow, status IN (1, 5, 6) AS declared, listed FROM fixes f JOIN ls0 USING (track_id)) SELECT in_zone, slow, declared, listed, count(*) AS n FROM f GROUP BY ALL")
def factor_table(spark, sf_dir):
    from wakeline.sources.fixes import zones

    f = fixes(spark, sf_dir)
    inside = J.in_squares(f, zones(spark, sf_dir)).select("event_id").distinct().withColumn("in_zone", F.lit(True))
    f = f.join(inside, "event_id", "left").join(listed_flag(spark, sf_dir), "track_id")
    return f.groupBy(F.coalesce("in_zone", F.lit(False)).alias("in_zone"), (F.coalesce("sog", F.lit(0.0)) < 6).alias("slow"), F.col("status").isin(*D.STATIC).alias("declared"), "listed").agg(F.count("*").alias("n"))


@query("AG34_marginal_points", EVENTS + RISK + ", mp AS (SELECT track_id, kind, ln(1 - 0.9e0 * least(p, 1)) AS l, sum(ln(1 - 0.9e0 * least(p, 1))) OVER (PARTITION BY track_id) AS s FROM pk) SELECT track_id, kind, round(100 * (exp(s - l) - exp(s)), 6) AS points FROM mp")
def marginal_points(spark, sf_dir):
    """What each kind adds to its vessel's risk: the risk less that without it."""
    weight = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in D.KIND_WEIGHT.items()], F.lit(0.8))
    p = weight * F.col("severity") * (0.6 + 0.4 * F.col("confidence")) / 100
    best = events(spark, sf_dir).withColumn("p", p).groupBy("track_id", "kind").agg(F.max("p").alias("p")).withColumn("l", F.log1p(-0.9 * F.least("p", F.lit(1.0))))
    s = F.sum("l").over(W.partitionBy("track_id"))
    return best.withColumn("s", s).select("track_id", "kind", F.round(100 * (F.exp(F.col("s") - F.col("l")) - F.exp("s")), 6).alias("points"))


@query("AG37_outcome_auc", EVENTS + RISK + ", " + LISTED + ", o AS (SELECT listed::INT AS y, round(risk, 6) AS r FROM rk JOIN ls0 USING (track_id)), ro AS (SELECT *, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0e0 AS ar FROM o) SELECT sum(y)::BIGINT AS listed, sum(1 - y)::BIGINT AS others, round((sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * sum(1 - y)), 6) AS auc, round(avg(CASE WHEN y = 1 THEN r END), 4) AS mean_listed, round(avg(CASE WHEN y = 0 THEN r END), 4) AS mean_others FROM ro")
def outcome_auc(spark, sf_dir):
    """How well the risk separates listed vessels from others."""
    d = D.risk(events(spark, sf_dir), ["track_id"]).withColumn("r", F.round("risk", 6)).join(listed_flag(spark, sf_dir), "track_id")
    auc = R.roc_auc(d, F.col("listed"), F.col("r"))
    mean = d.agg(F.round(F.avg(F.when(F.col("listed"), F.col("r"))), 4).alias("mean_listed"), F.round(F.avg(F.when(~F.col("listed"), F.col("r"))), 4).alias("mean_others"))
    return auc.select(F.col("positives").alias("listed"), F.col("negatives").alias("others"), F.round("auc", 6).alias("auc")).crossJoin(mean)


@query("J31_label_override", "WITH " + WIN + ", " + TRUTH + ", wk AS (SELECT segment_id, window_ordinal, CAST(substr(track_id, 2) AS BIGINT) AS user_id, ws AS a, ws + 432000 AS z, coalesce(sog_p95 >= 18, false)::INT AS weak FROM ft), cf AS (SELECT segment_id, window_ordinal, max((truth_id % 2)::INT) AS sure FROM wk JOIN tr ON tr.user_id = wk.user_id AND a <= tr.t1 AND z >= tr.t0 WHERE truth_id % 5 = 0 GROUP BY ALL) SELECT wk.segment_id, wk.window_ordinal, coalesce(sure, weak) AS label, sure IS NOT NULL AS confirmed FROM wk LEFT JOIN cf USING (segment_id, window_ordinal)")
def label_override(spark, sf_dir):
    """Weak labels of windows, replaced by those of confirmed intervals that they overlap."""
    w = window_features(spark, sf_dir).select("segment_id", "window_ordinal", F.substring("track_id", 2, 6).cast("long").alias("user_id"), F.col("window_start").alias("a"), (F.col("window_start") + 432_000).alias("z"), F.coalesce((F.col("sog_p95") >= 18).cast("int"), F.lit(0)).alias("weak"))
    sure = J.overlap_join(w.select("user_id", "segment_id", "window_ordinal", "a", "z"), truth(spark, sf_dir).where("truth_id % 5 = 0"), ["user_id"], ("a", "z"), ("a0", "a1"), 432_000.0)
    sure = sure.groupBy("segment_id", "window_ordinal").agg(F.max((F.col("truth_id") % 2).cast("int")).alias("sure"))
    out = w.join(sure, ["segment_id", "window_ordinal"], "left")
    return out.select("segment_id", "window_ordinal", F.coalesce("sure", "weak").alias("label"), F.col("sure").isNotNull().alias("confirmed"))


@query("AG49_confirmed_recall", "WITH " + WIN + ", " + TRUTH + ", fw AS (SELECT CAST(substr(track_id, 2) AS BIGINT) AS user_id, ws AS a, ws + 432000 AS z FROM ft WHERE sog_p95 >= 18), v AS (SELECT DISTINCT user_id FROM fixes) SELECT tr.truth_id, bool_or(coalesce(a <= tr.t1 AND z >= tr.t0, false)) AS exact, bool_or(coalesce(a - 86400 <= tr.t1 AND z + 86400 >= tr.t0, false)) AS within_day FROM tr JOIN v USING (user_id) LEFT JOIN fw ON fw.user_id = tr.user_id WHERE truth_id % 3 = 0 GROUP BY tr.truth_id")
def confirmed_recall(spark, sf_dir):
    """Whether a fast window meets each confirmed interval, exactly and within a day."""
    f = window_features(spark, sf_dir).where("sog_p95 >= 18").select(F.substring("track_id", 2, 6).cast("long").alias("user_id"), F.col("window_start").alias("a"), (F.col("window_start") + 432_000).alias("z"))
    tr = truth(spark, sf_dir).where("truth_id % 3 = 0").join(fixes(spark, sf_dir).select("user_id").distinct(), "user_id")
    near = J.overlap_join(f, tr, ["user_id"], ("a", "z"), ("a0", "a1"), 432_000.0, 86_400.0)
    hit = near.groupBy("truth_id").agg(F.bool_or((F.col("a") <= F.col("a1")) & (F.col("z") >= F.col("a0"))).alias("exact"), F.lit(True).alias("within_day"))
    return tr.select("truth_id").join(hit, "truth_id", "left").select("truth_id", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("within_day", F.lit(False)).alias("within_day"))


@query("SE2_ordered_distinct", f"WITH r AS (SELECT track_id, status, min((t, event_id)) AS o FROM fixes GROUP BY ALL) SELECT track_id, string_agg(CAST(status AS VARCHAR), ',' ORDER BY o) AS statuses FROM r GROUP BY track_id")
def ordered_distinct(spark, sf_dir):
    """Each vessel's statuses in order of first occurrence."""
    r = fixes(spark, sf_dir).groupBy("track_id", "status").agg(F.min(F.struct("t", "event_id")).alias("o"))
    g = r.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("o", "status"))).alias("x"))
    return g.select("track_id", F.array_join(F.transform("x", lambda s: s["status"].cast("string")), ",").alias("statuses"))


@query("SO6_event_ids", EVENTS + ", od AS (SELECT track_id, kind, round(t0, 3) AS t0, row_number() OVER (PARTITION BY track_id ORDER BY round(t0, 3), kind, round(t1, 3), round(severity, 6)) AS k FROM ev) SELECT track_id, kind, t0, 'E' || lpad(CAST(k AS VARCHAR), 3, '0') AS event FROM od")
def event_ids(spark, sf_dir):
    """Events of a vessel numbered by start."""
    e = events(spark, sf_dir).withColumns({"t0": F.round("t0", 3), "t1": F.round("t1", 3), "severity": F.round("severity", 6)})
    k = F.row_number().over(W.partitionBy("track_id").orderBy("t0", "kind", "t1", "severity"))
    return e.select("track_id", "kind", "t0", F.format_string("E%03d", k).alias("event"))


@query("SO8_path_description", f"WITH x AS (SELECT *, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM fixes), k AS (SELECT DISTINCT track_id, CAST(round_even(j * (n - 1) / 11.0e0, 0) AS BIGINT) AS i FROM x, (SELECT unnest(range(12)) AS j)) SELECT x.track_id, x.event_id FROM x JOIN k ON k.track_id = x.track_id AND k.i = x.i")
def path_description(spark, sf_dir):
    """Twelve reports of each track, evenly spaced by position."""
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    x = fixes(spark, sf_dir).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy("track_id"))})
    wanted = F.array(*[F.rint(j * (F.col("n") - 1) / 11.0).cast("int") for j in range(12)])
    return x.where(F.array_contains(wanted, F.col("i"))).select("track_id", "event_id")


RECEIVERS = ((22.6, 120.2, 60.0), (25.1, 121.7, 60.0), (24.2, 119.0, 40.0), (23.0, 122.4, 30.0))


@query("J12_receiver_coverage", "SELECT event_id, least(" + ", ".join(haversine("latitude", "longitude", f"{a}e0", f"{b}e0") + f" / 1852 / {r}e0" for a, b, r in RECEIVERS) + ") <= 1 AS covered FROM fixes")
def receiver_coverage(spark, sf_dir):
    share = [geo.haversine_nm(F.col("latitude"), F.col("longitude"), F.lit(a), F.lit(b)) / r for a, b, r in RECEIVERS]
    return fixes(spark, sf_dir).select("event_id", (F.least(*share) <= 1).alias("covered"))


@query("SC5_local_coordinates", "SELECT event_id, round(radians(longitude - 120.5e0) * 6371008.8e0 * cos(radians(24.0e0)), 3) AS x, round(radians(latitude - 24.0e0) * 6371008.8e0, 3) AS y FROM fixes")
def local_coordinates(spark, sf_dir):
    x, y = geo.project_xy_m(F.col("latitude"), F.col("longitude"), 24.0, 120.5)
    return fixes(spark, sf_dir).select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("AG51_port_utilisation", "WITH c AS (SELECT n_nationkey, n_name AS port, 3000 + n_nationkey * 137 AS capacity FROM nation), u AS (SELECT s_nationkey, sum(l_quantity)::DOUBLE AS used FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) SELECT port, coalesce(used, 0) AS used, round(CASE WHEN capacity > 0 THEN coalesce(used, 0) / capacity END, 6) AS utilisation FROM c LEFT JOIN u ON u.s_nationkey = c.n_nationkey", views=False)
def port_utilisation(spark, sf_dir):
    """Units shipped from each port against its capacity."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    used = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity").join(supplier, "l_suppkey").groupBy("n_nationkey").agg(F.sum("l_quantity").cast("double").alias("used"))
    c = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("port"), (3000 + F.col("n_nationkey") * 137).alias("capacity")).join(used, "n_nationkey", "left")
    u = F.coalesce("used", F.lit(0.0))
    return c.select("port", u.alias("used"), F.round(F.when(F.col("capacity") > 0, u / F.col("capacity")), 6).alias("utilisation"))


@query("SC17_route_scores", "WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS cost, l_quantity::DOUBLE AS units, l_discount::DOUBLE AS risk FROM lineitem), b AS (SELECT *, min(cost) OVER d AS c0, max(cost) OVER d AS c1, min(units) OVER d AS u0, max(units) OVER d AS u1 FROM r WINDOW d AS (PARTITION BY l_orderkey)), s AS (SELECT *, CASE WHEN c1 > c0 THEN (cost - c0) / (c1 - c0) ELSE 0 END AS nc, CASE WHEN u1 > u0 THEN (u1 - units) / (u1 - u0) ELSE 0 END AS nu FROM b) SELECT l_orderkey, l_linenumber, round(0.5e0 * nc + 0.3e0 * nu + 0.2e0 * least(risk * 10, 1), 6) AS score FROM s", views=False)
def route_scores(spark, sf_dir):
    """Cost, size and risk of each candidate, scaled within its demand and weighted."""
    d = W.partitionBy("l_orderkey")
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("cost"), F.col("l_quantity").cast("double").alias("units"), F.col("l_discount").cast("double").alias("risk"))
    r = r.withColumns({"c0": F.min("cost").over(d), "c1": F.max("cost").over(d), "u0": F.min("units").over(d), "u1": F.max("units").over(d)})
    nc = F.when(F.col("c1") > F.col("c0"), (F.col("cost") - F.col("c0")) / (F.col("c1") - F.col("c0"))).otherwise(0.0)
    nu = F.when(F.col("u1") > F.col("u0"), (F.col("u1") - F.col("units")) / (F.col("u1") - F.col("u0"))).otherwise(0.0)
    return r.select("l_orderkey", "l_linenumber", F.round(0.5 * nc + 0.3 * nu + 0.2 * F.least(F.col("risk") * 10, F.lit(1.0)), 6).alias("score"))
