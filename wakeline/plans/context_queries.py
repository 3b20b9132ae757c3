"""Queries for joins in space and time, and for context learned from history."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.operators import context as C
from wakeline.operators import encounters as E
from wakeline.operators import joins as J
from wakeline.operators import nearest as N
from wakeline.operators import tracks as T
from wakeline.plans.registry import haversine, query
from wakeline.sources.fixes import fixes, table, zones

STEP = 21_600.0

#: Latest report of each vessel in each six-hour step.
STEPS = "st AS (SELECT * FROM (SELECT *, CAST(floor(t / 21600) AS BIGINT) AS step, row_number() OVER (PARTITION BY track_id, floor(t / 21600) ORDER BY t DESC, event_id DESC) AS r FROM fixes) WHERE r = 1)"
PAIRS = STEPS + ", pr AS (SELECT a.step, a.track_id, b.track_id AS track_id2, a.sog, b.sog AS sog2, " + haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude") + " / 1852 AS nm FROM st a JOIN st b ON a.step = b.step AND a.track_id < b.track_id WHERE abs(a.latitude - b.latitude) <= 0.2)"
DENSE = """
dn AS (SELECT *, lead(t) OVER p AS nt, lead(latitude) OVER p AS nla, lead(longitude) OVER p AS nlo, lead(sog) OVER p AS nsog FROM fixes WINDOW p AS (PARTITION BY track_id ORDER BY t, event_id)),
dm AS (SELECT *, """ + haversine("latitude", "longitude", "nla", "nlo") + """ / 1852 AS nm FROM dn),
dk AS (SELECT *, CASE WHEN nt - t <= 7200 AND nm / greatest(nt - t, 1) * 3600 <= 50 THEN least(greatest(ceil(nm / 1.0), 1), 400) ELSE 1 END::BIGINT AS n FROM dm),
dp AS (SELECT *, unnest(range(0, n)) AS k FROM dk),
dense AS (SELECT track_id, event_id, k, CASE WHEN nt IS NULL THEN t ELSE t + k / n * (nt - t) END AS t, CASE WHEN nt IS NULL THEN latitude ELSE latitude + k / n * (nla - latitude) END AS latitude,
  CASE WHEN nt IS NULL THEN longitude ELSE longitude + k / n * (nlo - longitude) END AS longitude, CASE WHEN nt IS NULL THEN sog ELSE (sog + nsog) / 2 END AS sog FROM dp)"""
CELLS = "cells AS (SELECT CAST(floor(latitude / 0.5) AS INT) AS ci, CAST(floor(longitude / 0.5) AS INT) AS cj, count(DISTINCT track_id) AS vessels FROM fixes WHERE coalesce(sog, 0) >= 3 GROUP BY ALL)"
NEXT = "nx AS (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t, event_id) - t AS dt FROM fixes)"


def steps(spark, sf_dir):
    w = W.partitionBy("track_id", "step").orderBy(F.desc("t"), F.desc("event_id"))
    df = fixes(spark, sf_dir).withColumn("step", F.floor(F.col("t") / STEP))
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def close_pairs(spark, sf_dir, radius_nm: float = 6.0):
    pairs = J.cell_self_join(steps(spark, sf_dir), ["step"], "track_id", "longitude", "latitude", 0.15, ("sog",))
    nm = geo.haversine_nm(F.col("latitude"), F.col("longitude"), F.col("latitude2"), F.col("longitude2"))
    return pairs.withColumn("nm", nm).where(F.col("nm") <= radius_nm)


@query("J2_zone_containment", "SELECT f.event_id, z.zone_id, z.kind FROM fixes f JOIN zones z ON abs(f.longitude - z.lon_c) <= z.half_deg AND abs(f.latitude - z.lat_c) <= z.half_deg")
def zone_containment(spark, sf_dir):
    return J.in_squares(fixes(spark, sf_dir), zones(spark, sf_dir)).select("event_id", "zone_id", "kind")


@query("J2_polygon_containment", "SELECT f.event_id, z.zone_id FROM fixes f JOIN zones z ON f.longitude >= z.lon_c - z.half_deg AND f.longitude < z.lon_c + z.half_deg AND f.latitude >= z.lat_c - z.half_deg AND f.latitude < z.lat_c + z.half_deg AND abs(f.longitude - z.lon_c) <= z.half_deg AND abs(f.latitude - z.lat_c) <= z.half_deg")
def polygon_containment(spark, sf_dir):
    """The same zones as rings: bounding squares first, then the even-odd rule."""
    hits = J.in_squares(fixes(spark, sf_dir), zones(spark, sf_dir))
    return hits.where(geo.in_polygon(F.col("latitude"), F.col("longitude"), F.col("ring"))).select("event_id", "zone_id")


@query("J3_nearest_port", "WITH d AS (SELECT f.event_id, z.zone_id, greatest(0, " + haversine("f.latitude", "f.longitude", "z.lat_c", "z.lon_c") + " / 1852 - 9) AS nm FROM fixes f JOIN zones z ON z.kind = 'port'), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY nm, zone_id) AS r FROM d) SELECT event_id, zone_id, round(nm, 5) AS nm FROM r WHERE r = 1")
def nearest_port(spark, sf_dir):
    """The nearest port and the distance to its edge, by rings of cells."""
    ports = zones(spark, sf_dir).where("kind = 'port'").select("zone_id", F.col("lat_c").alias("site_lat"), F.col("lon_c").alias("site_lon"))
    out = N.nearest_join(fixes(spark, sf_dir), ports, "event_id", "zone_id", parts=256)
    return out.select("event_id", "zone_id", F.round(F.greatest(F.lit(0.0), F.col("nm") - 9), 5).alias("nm"))


@query("J6_raster_lookup", "WITH p AS (SELECT event_id, greatest(0, least(9, round_even((latitude - 21.5e0) / 0.5e0, 0)))::INT AS i, greatest(0, least(11, round_even((longitude - 118e0) / 0.5e0, 0)))::INT AS j FROM fixes) SELECT event_id, (i * 12 + j) % 7 AS code FROM p")
def raster_lookup(spark, sf_dir):
    raster = spark.range(120).select((F.col("id") / 12).cast("int").alias("i"), (F.col("id") % 12).cast("int").alias("j"), (F.col("id") % 7).cast("int").alias("code"))
    return J.raster_lookup(fixes(spark, sf_dir), raster, F.col("longitude"), F.col("latitude"), 118.0, 21.5, 0.5, (10, 12)).select("event_id", "code")


@query("J8_close_pairs", "WITH " + PAIRS + " SELECT step, track_id, track_id2, round(nm, 6) AS nm, coalesce(sog, 0) <= 10 AND coalesce(sog2, 0) <= 10 AS both_slow FROM pr WHERE nm <= 6")
def close_pairs_query(spark, sf_dir):
    slow = (F.coalesce("sog", F.lit(0.0)) <= 10) & (F.coalesce("sog2", F.lit(0.0)) <= 10)
    return close_pairs(spark, sf_dir).select("step", "track_id", "track_id2", F.round("nm", 6).alias("nm"), slow.alias("both_slow"))


@query("J9_neighbours", "WITH " + PAIRS + ", n AS (SELECT step, track_id AS v, nm FROM pr WHERE nm <= 6 UNION ALL SELECT step, track_id2, nm FROM pr WHERE nm <= 6) SELECT st.step, st.track_id, count(n.nm) AS neighbours, round(coalesce(min(n.nm), 99), 6) AS nearest_nm FROM st LEFT JOIN n ON n.step = st.step AND n.v = st.track_id GROUP BY ALL")
def neighbours(spark, sf_dir):
    p = close_pairs(spark, sf_dir)
    both = p.select("step", "track_id", "nm").union(p.select("step", "track_id2", "nm"))
    found = both.groupBy("step", "track_id").agg(F.count("*").alias("neighbours"), F.min("nm").alias("nearest_nm"))
    out = steps(spark, sf_dir).select("step", "track_id").join(found, ["step", "track_id"], "left")
    return out.select("step", "track_id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.round(F.coalesce("nearest_nm", F.lit(99.0)), 6).alias("nearest_nm"))


@query("WN15_pair_runs", "WITH " + PAIRS + ", c AS (SELECT step, track_id, track_id2, nm FROM pr WHERE nm <= 6), g AS (SELECT *, CASE WHEN step - lag(step) OVER p <= 2 THEN 0 ELSE 1 END AS b FROM c WINDOW p AS (PARTITION BY track_id, track_id2 ORDER BY step)), r AS (SELECT *, sum(b) OVER (PARTITION BY track_id, track_id2 ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT track_id, track_id2, min(step) AS k0, max(step) AS k1, count(*) AS steps FROM r GROUP BY track_id, track_id2, run HAVING count(*) >= 0.6 * (max(step) - min(step) + 1)")
def pair_runs(spark, sf_dir):
    """Runs of a pair over steps: one missing step is tolerated, at least 60 % of steps are present."""
    return E.encounters(steps(spark, sf_dir), 6.0).select("track_id", "track_id2", "k0", "k1", "steps")


@query("J13_status_asof", "WITH g AS (SELECT track_id, unnest(range(19723, 19753)) * 86400.0e0 AS t FROM (SELECT DISTINCT track_id FROM fixes)) SELECT g.track_id, CAST(g.t AS BIGINT) AS at, f.status FROM g ASOF LEFT JOIN fixes f ON f.track_id = g.track_id AND g.t >= f.t")
def status_asof(spark, sf_dir):
    """Each vessel's last status at each midnight."""
    df = fixes(spark, sf_dir)
    grid = df.select("track_id").distinct().withColumn("d", F.explode(F.sequence(F.lit(19723), F.lit(19752)))).select("track_id", (F.col("d") * 86400.0).alias("t"))
    out = J.asof_backward(grid, df.select("track_id", "t", "event_id", "status"), ["track_id"], "t", ["event_id", "status"])
    return out.select("track_id", F.col("t").cast("long").alias("at"), "status")


@query(
    "WN12_grid_positions",
    """WITH g AS (SELECT track_id, unnest(range(19723, 19753)) * 86400.0e0 AS t FROM (SELECT DISTINCT track_id FROM fixes)),
    a AS (SELECT g.track_id, g.t, f.t AS t0, f.latitude AS y0 FROM g ASOF LEFT JOIN fixes f ON f.track_id = g.track_id AND g.t >= f.t),
    b AS (SELECT a.*, f.t AS t1, f.latitude AS y1 FROM a ASOF LEFT JOIN fixes f ON f.track_id = a.track_id AND a.t <= f.t)
    SELECT track_id, CAST(t AS BIGINT) AS at, round(CASE WHEN least(t - t0, t1 - t) <= 21600 AND t0 IS NOT NULL AND t1 IS NOT NULL THEN y0 + CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END * (y1 - y0) END, 6) AS latitude FROM b""",
)
def grid_positions(spark, sf_dir):
    """Latitude at each midnight, between the reports around, if the nearer is within six hours."""
    df = fixes(spark, sf_dir)
    grid = df.select("track_id").distinct().withColumn("d", F.explode(F.sequence(F.lit(19723), F.lit(19752)))).select("track_id", (F.col("d") * 86400.0).alias("t"))
    out = J.interpolate(grid, df.select("track_id", "t", "latitude"), ["track_id"], "t", ["latitude"], STEP)
    return out.select("track_id", F.col("t").cast("long").alias("at"), F.round("latitude", 6).alias("latitude"))


@query("J16_watch_list", "SELECT DISTINCT f.track_id FROM fixes f JOIN supplier s ON s.s_suppkey = f.user_id WHERE s.s_acctbal < 0")
def watch_list(spark, sf_dir):
    listed = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    return fixes(spark, sf_dir).join(listed, "user_id", "left_semi").select("track_id").distinct()


@query("J17_listed_flag", "SELECT DISTINCT f.track_id, EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = f.user_id AND s.s_acctbal < 0) AS listed FROM fixes f")
def listed_flag(spark, sf_dir):
    listed = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id")).distinct().withColumn("listed", F.lit(True))
    vessels = fixes(spark, sf_dir).select("track_id", "user_id").distinct()
    return vessels.join(listed, "user_id", "left").select("track_id", F.coalesce("listed", F.lit(False)).alias("listed"))


TRUTH = "tr AS (SELECT o_orderkey AS truth_id, o_custkey AS user_id, 1704067200.0e0 + (o_orderkey * 977 % 2500000) AS t0, 1704067200.0e0 + (o_orderkey * 977 % 2500000) + 3600 * (1 + o_orderkey % 12) AS t1 FROM orders)"


def truth(spark, sf_dir):
    start = 1704067200.0 + F.col("o_orderkey") * 977 % 2500000
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("truth_id"), F.col("o_custkey").alias("user_id"), start.alias("a0"), (start + 3600 * (1 + F.col("o_orderkey") % 12)).alias("a1"))


@query("J18_reports_in_truth", "WITH " + TRUTH + " SELECT f.event_id, tr.truth_id FROM fixes f JOIN tr ON tr.user_id = f.user_id AND f.t BETWEEN tr.t0 AND tr.t1")
def reports_in_truth(spark, sf_dir):
    return J.range_bucket_join(fixes(spark, sf_dir), truth(spark, sf_dir), ["user_id"], "t", "a0", "a1", 86_400.0).select("event_id", "truth_id")


@query("J19_gaps_near_truth", "WITH " + TRUTH + ", g AS (SELECT event_id, user_id, t AS g1, lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS g0 FROM fixes), q AS (SELECT * FROM g WHERE g1 - g0 >= 86400) SELECT q.event_id, tr.truth_id FROM q JOIN tr ON tr.user_id = q.user_id AND q.g0 - 3600 <= tr.t1 AND q.g1 + 3600 >= tr.t0")
def gaps_near_truth(spark, sf_dir):
    gaps = T.with_gaps(fixes(spark, sf_dir)).where("gap >= 86400").select("event_id", "user_id", (F.col("t") - F.col("gap")).alias("g0"), F.col("t").alias("g1"))
    return J.overlap_join(gaps, truth(spark, sf_dir), ["user_id"], ("g0", "g1"), ("a0", "a1"), 86_400.0, 3600.0).select("event_id", "truth_id")


@query("WN10_densified", "WITH " + DENSE + " SELECT track_id, count(*) AS n, round(sum(latitude), 4) AS lat, round(sum(longitude), 4) AS lon FROM dense GROUP BY track_id")
def densified(spark, sf_dir):
    d = C.densify(fixes(spark, sf_dir), 1.0, 7200.0)
    return d.groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.sum("latitude"), 4).alias("lat"), F.round(F.sum("longitude"), 4).alias("lon"))


@query("AG13_traffic_cells", "WITH " + CELLS + " SELECT * FROM cells")
def traffic_cells(spark, sf_dir):
    return C.traffic_cells(fixes(spark, sf_dir))


@query("J10_familiarity", "WITH " + CELLS + ", o AS (SELECT unnest([-1, 0, 1]) AS d) SELECT ci + a.d AS ci, cj + b.d AS cj, sum(vessels) / 4.0e0 AS familiarity FROM cells, o a, o b GROUP BY ALL")
def familiarity(spark, sf_dir):
    return C.familiarity(C.traffic_cells(fixes(spark, sf_dir)))


@query("AG14_stop_cells", "WITH " + NEXT + ", s AS (SELECT CAST(floor(latitude / 0.5) AS INT) AS ci, CAST(floor(longitude / 0.5) AS INT) AS cj, track_id, sum(dt) AS s FROM nx WHERE coalesce(sog, 0) < 3 AND dt > 0 AND dt <= 86400 GROUP BY ALL) SELECT ci, cj, count(*) AS vessels FROM s WHERE s >= 3600 GROUP BY ALL")
def stop_cells(spark, sf_dir):
    return C.stop_cells(fixes(spark, sf_dir))


@query("J11_expected_interval", "WITH " + NEXT + ", m AS (SELECT CAST(floor(latitude / 0.5) AS INT) AS ci, CAST(floor(longitude / 0.5) AS INT) AS cj, quantile_cont(dt, 0.5) AS i FROM nx WHERE dt > 0 GROUP BY ALL HAVING count(*) >= 120) SELECT f.event_id, round(coalesce(m.i, 600), 3) AS expected FROM fixes f LEFT JOIN m ON m.ci = floor(f.latitude / 0.5) AND m.cj = floor(f.longitude / 0.5)")
def expected_interval(spark, sf_dir):
    df = fixes(spark, sf_dir)
    cells = C.expected_interval(df, 0.5, 120)
    out = df.withColumns({"ci": geo.cell(F.col("latitude"), 0.5), "cj": geo.cell(F.col("longitude"), 0.5)}).join(cells, ["ci", "cj"], "left")
    return out.select("event_id", F.round(F.coalesce("interval", F.lit(600.0)), 3).alias("expected"))


@query("AG15_gap_habits", "WITH l AS (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS g FROM fixes) SELECT track_id, round(quantile_cont(g, 0.95), 3) AS gap_p95 FROM l WHERE g > 0 GROUP BY track_id HAVING count(*) >= 15")
def gap_habits(spark, sf_dir):
    return C.gap_habits(fixes(spark, sf_dir)).select("track_id", F.round("gap_p95", 3).alias("gap_p95"))


@query("AG16_peer_percentile", "WITH l AS (SELECT event_id, vessel_type, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS gap FROM fixes), g AS (SELECT * FROM l WHERE gap > 0) SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY vessel_type) >= 300 THEN (rank() OVER (PARTITION BY vessel_type ORDER BY gap) - 1) / count(*) OVER (PARTITION BY vessel_type) END, 6) AS peer FROM g")
def peer_percentile(spark, sf_dir):
    gaps = T.with_gaps(fixes(spark, sf_dir)).where("gap > 0")
    return C.peer_percentile(gaps, 300).select("event_id", F.round("peer", 6).alias("peer"))


@query("AG45_crowds", "WITH s AS (SELECT CAST(floor(t / 86400) AS BIGINT) AS d, CAST(trunc(latitude / 0.5) AS INT) AS ci, CAST(trunc(longitude / 0.5) AS INT) AS cj, track_id FROM fixes WHERE coalesce(sog, 0) <= 10), o AS (SELECT unnest([-1, 0, 1]) AS k), x AS (SELECT d, ci + a.k AS ci, cj + b.k AS cj, track_id FROM s, o a, o b) SELECT d, ci, cj, count(DISTINCT track_id) AS crowd FROM x GROUP BY ALL")
def crowds(spark, sf_dir):
    """Distinct slow vessels in the 3 x 3 cells around each cell and day; cells truncate toward zero."""
    s = fixes(spark, sf_dir).where(F.coalesce("sog", F.lit(0.0)) <= 10)
    s = s.select(F.floor(F.col("t") / 86400).alias("d"), (F.col("latitude") / 0.5).cast("int").alias("_i"), (F.col("longitude") / 0.5).cast("int").alias("_j"), "track_id").distinct()
    near = F.array(*[F.struct((F.col("_i") + a).alias("ci"), (F.col("_j") + b).alias("cj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return s.select("d", "track_id", F.inline(near)).groupBy("d", "ci", "cj").agg(F.count_distinct("track_id").alias("crowd"))


@query("AG41_traffic_context", "SELECT floor(latitude * 10 + 0.5e0)::BIGINT AS lat10, floor(longitude * 10 + 0.5e0)::BIGINT AS lon10, count(*) AS observations, count(DISTINCT track_id) AS vessels, count(DISTINCT floor(t / 86400)) AS days, count(DISTINCT floor(t / 3600)) AS hours FROM fixes GROUP BY ALL")
def traffic_context(spark, sf_dir):
    g = fixes(spark, sf_dir).groupBy(F.floor(F.col("latitude") * 10 + 0.5).alias("lat10"), F.floor(F.col("longitude") * 10 + 0.5).alias("lon10"))
    return g.agg(F.count("*").alias("observations"), F.count_distinct("track_id").alias("vessels"), F.count_distinct(F.floor(F.col("t") / 86400)).alias("days"), F.count_distinct(F.floor(F.col("t") / 3600)).alias("hours"))


@query("AG42_identity_status", "WITH x AS (SELECT o_clerk AS mmsi, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1) SELECT mmsi, CASE WHEN mmsi IS NULL THEN 'missing' WHEN NOT regexp_full_match(mmsi, '[0-9]{9}') THEN 'not_nine_digits' WHEN n = 1 THEN 'unique' ELSE 'shared' END AS status FROM (SELECT lpad(CAST(o_custkey % 40 * 26000007 % 1000000007 AS VARCHAR), CASE WHEN o_custkey % 7 = 0 THEN 10 ELSE 9 END, '2') AS mmsi, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)".replace("WITH x AS (SELECT o_clerk AS mmsi, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1) ", ""), views=False)
def identity_status(spark, sf_dir):
    c = F.col("o_custkey")
    mmsi = F.when(c % 7 == 0, F.lpad((c % 40 * 26000007 % 1000000007).cast("string"), 10, "2")).otherwise(F.lpad((c % 40 * 26000007 % 1000000007).cast("string"), 9, "2"))
    g = table(spark, sf_dir, "orders").groupBy(mmsi.alias("mmsi")).agg(F.count_distinct("o_custkey").alias("n"))
    from wakeline.functions.identity import nine_digits

    status = F.when(F.col("mmsi").isNull(), "missing").when(~nine_digits(F.col("mmsi")), "not_nine_digits").when(F.col("n") == 1, "unique").otherwise("shared")
    return g.select("mmsi", status.alias("status"))
