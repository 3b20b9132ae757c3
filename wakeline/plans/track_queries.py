"""Queries over position reports: cleaning, sessions, windows, features, and their quality figures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo, identity
from wakeline.operators import tracks as T
from wakeline.plans.registry import haversine, query
from wakeline.sources.fixes import fixes, table

#: Days instead of minutes: an actor's reports are hours apart.
CFG = T.TrackConfig(segment_gap_s=86_400.0, window_s=432_000.0, stride_s=86_400.0, min_observations=10, min_span_s=345_600.0, min_valid_fraction=0.6)
METRES = ("path_m", "displacement_m", "path_ratio")
BOX = (119.0, 22.0, 121.0, 25.0)
R6 = lambda *cols: [F.round(F.col(c), 6).alias(c) for c in cols]

SEG = """
l AS (SELECT *, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS gap FROM fixes),
s AS (SELECT *, CAST(sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS ord FROM l),
seg AS (SELECT *, track_id || ':s' || lpad(CAST(ord AS VARCHAR), 4, '0') AS segment_id,
  CASE WHEN lag(ord) OVER (PARTITION BY track_id ORDER BY t, event_id) = ord THEN gap END AS sgap FROM s)"""

WIN = SEG + """,
b AS (SELECT segment_id, min(t) AS t0, max(t) AS t1 FROM seg GROUP BY segment_id),
o AS (SELECT segment_id, t0, unnest(range(0, CAST(floor((t1 - t0 - 432000) / 86400) AS BIGINT) + 1)) AS k FROM b WHERE t1 - t0 >= 432000),
win AS (SELECT seg.*, o.k, o.t0 + o.k * 86400 AS ws FROM o JOIN seg ON seg.segment_id = o.segment_id AND seg.t >= o.t0 + o.k * 86400 AND seg.t < o.t0 + o.k * 86400 + 432000),
pr AS (SELECT *, lag(t) OVER p AS pt, lag(sog) OVER p AS psog, lag(cog) OVER p AS pcog, lag(latitude) OVER p AS plat, lag(longitude) OVER p AS plon FROM win
  WINDOW p AS (PARTITION BY segment_id, k ORDER BY t, event_id)),
q AS (SELECT *, coalesce(sog >= 1 AND psog >= 1 AND cog IS NOT NULL AND pcog IS NOT NULL, false) AS el,
  abs((((cog - pcog + 180) % 360) + 360) % 360 - 180) AS turn, abs((((heading - cog + 180) % 360) + 360) % 360 - 180) AS drift, """ + haversine("plat", "plon", "latitude", "longitude") + """ AS leg FROM pr),
f AS (SELECT track_id, segment_id, k, min(ws) AS ws, count(*) AS n, max(t) - min(t) AS span, count(sog) AS n_sog, count(cog) AS n_cog,
  sum(CASE WHEN cog IS NOT NULL AND heading IS NOT NULL THEN 1 ELSE 0 END) AS n_pairs, sum(CASE WHEN el THEN 1 ELSE 0 END) AS n_el,
  quantile_cont(sog, 0.5) AS sm, quantile_cont(sog, 0.95) AS s95, avg(CASE WHEN sog IS NULL THEN NULL WHEN sog < 3 THEN 1.0 ELSE 0.0 END) AS lf,
  sum(CASE WHEN sog < 3 AND psog < 3 AND t > pt THEN t - pt ELSE 0 END) AS ls, sum(coalesce(leg, 0)) AS path,
  arg_min(latitude, (t, event_id)) AS la0, arg_min(longitude, (t, event_id)) AS lo0, arg_max(latitude, (t, event_id)) AS la1, arg_max(longitude, (t, event_id)) AS lo1,
  sum(CASE WHEN el THEN turn END) AS ts, quantile_cont(CASE WHEN el THEN turn END, 0.95) AS t95, quantile_cont(drift, 0.5) AS dm
  FROM q GROUP BY track_id, segment_id, k),
wt AS (SELECT *, CASE WHEN n < 10 THEN 'too_few_reports' WHEN span < 345600 THEN 'span_too_short' ELSE 'sufficient' END AS quality, """ + haversine("la0", "lo0", "la1", "lo1") + """ AS shift FROM f),
ft AS (SELECT track_id, segment_id, k AS window_ordinal, quality,
  CASE WHEN quality = 'sufficient' AND n_sog / n >= 0.6 THEN sm END AS sog_median, CASE WHEN quality = 'sufficient' AND n_sog / n >= 0.6 THEN s95 END AS sog_p95,
  CASE WHEN quality = 'sufficient' AND n_sog / n >= 0.6 THEN lf END AS low_speed_fraction, CASE WHEN quality = 'sufficient' AND n_sog / n >= 0.6 THEN ls END AS low_speed_s,
  CASE WHEN quality = 'sufficient' THEN path END AS path_m, CASE WHEN quality = 'sufficient' THEN shift END AS displacement_m,
  CASE WHEN quality = 'sufficient' AND shift >= 50 THEN path / shift END AS path_ratio,
  CASE WHEN quality = 'sufficient' AND n_cog / n >= 0.6 AND n_el >= 2 THEN ts END AS turn_sum, CASE WHEN quality = 'sufficient' AND n_cog / n >= 0.6 AND n_el >= 2 THEN t95 END AS turn_p95,
  CASE WHEN quality = 'sufficient' AND n_pairs / n >= 0.6 THEN dm END AS drift_median, ws, n, span, n_sog, n_cog, n_pairs, n_el FROM wt)"""


def _segments(spark, sf_dir):
    return T.segments(fixes(spark, sf_dir), CFG)


def window_features(spark, sf_dir):
    return T.window_table(T.windows(_segments(spark, sf_dir), CFG), CFG)


def _rounded(columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query("IO4_region_crop", "SELECT event_id, track_id, longitude, latitude FROM fixes WHERE longitude BETWEEN 119.0e0 AND 121.0e0 AND latitude BETWEEN 22.0e0 AND 25.0e0")
def region_crop(spark, sf_dir):
    df = fixes(spark, sf_dir)
    return df.where(geo.in_box(F.col("longitude"), F.col("latitude"), BOX)).select("event_id", "track_id", "longitude", "latitude")


@query("F5_cargo_filter", "SELECT event_id, vessel_type FROM fixes WHERE vessel_type BETWEEN 70 AND 79")
def cargo(spark, sf_dir):
    return fixes(spark, sf_dir).where(identity.is_cargo(F.col("vessel_type"))).select("event_id", "vessel_type")


@query("F6_surrogate_track_id", "SELECT DISTINCT track_id, substr(sha256(track_id || ':' || strftime(base_date_time, '%Y-%m-%d')), 1, 16) AS surrogate FROM fixes")
def surrogate(spark, sf_dir):
    day = F.date_format("base_date_time", "yyyy-MM-dd")
    return fixes(spark, sf_dir).select("track_id", identity.surrogate_track_id(F.col("track_id"), day).alias("surrogate")).distinct()


@query(
    "F9_clean_kinematics",
    """SELECT count(*) AS n, sum(CASE WHEN 10 - sog >= 0 THEN 1 ELSE 0 END)::BIGINT AS n_sog, sum(CASE WHEN cog + 100 < 360 THEN 1 ELSE 0 END)::BIGINT AS n_cog,
    sum(CASE WHEN heading + 100 <= 359 THEN 1 ELSE 0 END)::BIGINT AS n_heading FROM fixes""",
)
def clean(spark, sf_dir):
    """Valid values after shifting all kinematics, so that some fall out of range."""
    df = fixes(spark, sf_dir).withColumns({"sog": 10 - F.col("sog"), "cog": F.col("cog") + 100, "heading": F.col("heading") + 100})
    return T.clean_kinematics(df).agg(F.count("*").alias("n"), F.count("sog").alias("n_sog"), F.count("cog").alias("n_cog"), F.count("heading").alias("n_heading"))


@query(
    "F10_out_of_order",
    "WITH x AS (SELECT track_id, t < lag(t) OVER (PARTITION BY track_id ORDER BY (event_id * 31) % 1009, event_id) AS late FROM fixes) SELECT track_id, sum(CASE WHEN late THEN 1 ELSE 0 END)::BIGINT AS n_late FROM x GROUP BY track_id",
)
def out_of_order(spark, sf_dir):
    """Reports that arrive before an older one of their track, in a made-up order of arrival."""
    w = W.partitionBy("track_id").orderBy(F.col("event_id") * 31 % 1009, "event_id")
    df = fixes(spark, sf_dir).withColumn("late", F.col("t") < F.lag("t").over(w))
    return df.groupBy("track_id").agg(F.count_if("late").alias("n_late"))


@query("F33_thinning", "WITH x AS (SELECT event_id, track_id, row_number() OVER (PARTITION BY track_id, floor(t / 86400) ORDER BY t, event_id) AS r FROM fixes) SELECT event_id, track_id FROM x WHERE r = 1")
def thinning(spark, sf_dir):
    """The first report of each track and day."""
    first = F.row_number().over(W.partitionBy("track_id", F.floor(F.col("t") / 86400)).orderBy("t", "event_id"))
    return fixes(spark, sf_dir).withColumn("r", first).where("r = 1").select("event_id", "track_id")


@query("F20_minimum_fixes", "WITH x AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM fixes) SELECT event_id, track_id FROM x WHERE n >= 70")
def minimum_fixes(spark, sf_dir):
    df = fixes(spark, sf_dir)
    return df.withColumn("n", F.count("*").over(W.partitionBy("track_id"))).where("n >= 70").select("event_id", "track_id")


@query("AG1_duplicates", "WITH u AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 5 = 0), d AS (SELECT DISTINCT event_id, user_id, ts, event_type FROM u) SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM d GROUP BY user_id", views=False)
def duplicates(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    again = df.union(df.where("event_id % 5 = 0"))
    return T.drop_exact_duplicates(again).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query(
    "AG2_gap_statistics",
    """WITH l AS (SELECT t - lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS g FROM fixes)
    SELECT count(g) AS pairs, sum(CASE WHEN g > 0 THEN 1 ELSE 0 END)::BIGINT AS positive, sum(CASE WHEN g = 0 THEN 1 ELSE 0 END)::BIGINT AS zero, sum(CASE WHEN g < 0 THEN 1 ELSE 0 END)::BIGINT AS negative,
    sum(CASE WHEN g > 86400 THEN 1 ELSE 0 END)::BIGINT AS above, round(min(CASE WHEN g > 0 THEN g END), 3) AS least, round(quantile_cont(CASE WHEN g > 0 THEN g END, 0.5), 3) AS median, round(max(g), 3) AS most FROM l""",
)
def gap_statistics(spark, sf_dir):
    out = T.gap_statistics(fixes(spark, sf_dir), 86_400.0)
    return out.select("pairs", "positive", "zero", "negative", "above", *[F.round(c, 3).alias(c) for c in ("least", "median", "most")])


@query("AG3_whole_tracks", None)
def whole_tracks(spark, sf_dir):
    df = fixes(spark, sf_dir)
    return T.whole_tracks(df, 5000).groupBy("track_id").agg(F.count("*").alias("n"))


@query("AG4_missing_rates", "SELECT round(avg(CASE WHEN sog IS NULL THEN 1.0 ELSE 0.0 END), 6) AS sog, round(avg(CASE WHEN cog IS NULL THEN 1.0 ELSE 0.0 END), 6) AS cog, round(avg(CASE WHEN heading IS NULL THEN 1.0 ELSE 0.0 END), 6) AS heading FROM fixes")
def missing_rates(spark, sf_dir):
    return fixes(spark, sf_dir).agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in ("sog", "cog", "heading")])


@query("WN1_preceding_gap", "SELECT event_id, round(t - lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id), 6) AS gap FROM fixes")
def preceding_gap(spark, sf_dir):
    return T.with_gaps(fixes(spark, sf_dir)).select("event_id", *R6("gap"))


@query("WN2_gap_sessions", "WITH " + SEG + " SELECT event_id, segment_id, ord AS segment_ordinal FROM seg")
def gap_sessions(spark, sf_dir):
    return _segments(spark, sf_dir).select("event_id", "segment_id", "segment_ordinal")


@query(
    "AG5_segment_summary",
    "WITH " + SEG + """, g AS (SELECT segment_id, count(*) AS n, max(t) - min(t) AS d, quantile_cont(sgap, 0.5) AS mg, max(sgap) AS xg, count(sog) AS n_sog, count(cog) AS n_cog, count(heading) AS n_heading FROM seg GROUP BY segment_id)
    SELECT segment_id, n, round(d, 3) AS duration_s, round(mg, 3) AS median_gap, round(xg, 3) AS max_gap, n_sog, n_cog, n_heading, round(n_sog / n, 6) AS sog_fraction,
    CASE WHEN n < 2 THEN 'single_report' WHEN d <= 0 THEN 'no_duration' ELSE 'ok' END AS quality FROM g""",
)
def segment_summary(spark, sf_dir):
    out = T.segment_summary(_segments(spark, sf_dir))
    return out.select("segment_id", "n", *[F.round(c, 3).alias(c) for c in ("duration_s", "median_gap", "max_gap")], "n_sog", "n_cog", "n_heading", *R6("sog_fraction"), "quality")


@query("WN3_sliding_windows", "WITH " + WIN + " SELECT segment_id, k AS window_ordinal, event_id FROM win")
def sliding_windows(spark, sf_dir):
    return T.windows(_segments(spark, sf_dir), CFG).select("segment_id", "window_ordinal", "event_id")


@query("AG6_window_metadata", "WITH " + WIN + " SELECT segment_id, window_ordinal, n, round(span, 3) AS span_s, n_sog, n_cog, n_pairs::BIGINT AS n_pairs, n_el::BIGINT AS n_course_pairs, quality FROM ft")
def window_metadata(spark, sf_dir):
    return window_features(spark, sf_dir).select("segment_id", "window_ordinal", "n", F.round("span_s", 3).alias("span_s"), "n_sog", "n_cog", "n_pairs", "n_course_pairs", "quality")


@query("AG7_window_features", "WITH " + WIN + f" SELECT segment_id, window_ordinal, {_rounded(x for x in T.FEATURES if x not in METRES)}, round(path_m, 3) AS path_m, round(displacement_m, 3) AS displacement_m, round(path_ratio, 3) AS path_ratio FROM ft")
def features(spark, sf_dir):
    return window_features(spark, sf_dir).select("segment_id", "window_ordinal", *R6(*[x for x in T.FEATURES if x not in METRES]), *[F.round(x, 3).alias(x) for x in METRES])


_LONG = " UNION ALL ".join(f"SELECT '{x}' AS feature, {x} AS v FROM ft" for x in T.FEATURES)


@query("AG8_distributions", "WITH " + WIN + f", x AS ({_LONG}) SELECT feature, count(v) AS n, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, round(min(v), 4) AS lo, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.95), 4) AS p95, round(max(v), 4) AS hi FROM x GROUP BY feature")
def distributions(spark, sf_dir):
    out = T.distribution_summary(window_features(spark, sf_dir).select(*T.FEATURES), T.FEATURES)
    return out.select("feature", "n", "missing", *[F.round(c, 4).alias(c) for c in ("lo", "p25", "median", "p75", "p95", "hi")])


@query("AG9_missingness", "WITH " + WIN + f", x AS ({_LONG}) SELECT feature, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM x GROUP BY feature")
def missingness(spark, sf_dir):
    long = window_features(spark, sf_dir).select(*T.FEATURES).unpivot([], list(T.FEATURES), "feature", "value")
    return long.groupBy("feature").agg(F.round(F.avg(F.col("value").isNull().cast("double")), 6).alias("missing"))


@query("AG10_rejections", "WITH " + WIN + " SELECT quality, count(*) AS n FROM ft WHERE quality <> 'sufficient' GROUP BY quality")
def rejections(spark, sf_dir):
    return window_features(spark, sf_dir).where("quality <> 'sufficient'").groupBy("quality").agg(F.count("*").alias("n"))


@query("AG11_windows_per_track", "WITH " + WIN + " SELECT x.track_id, count(ft.window_ordinal) AS n FROM (SELECT DISTINCT track_id FROM fixes) x LEFT JOIN ft ON ft.track_id = x.track_id GROUP BY x.track_id")
def windows_per_track(spark, sf_dir):
    return T.zero_inclusive(fixes(spark, sf_dir), window_features(spark, sf_dir), "track_id")


@query("AG12_cohort_share", "WITH " + WIN + ", c AS (SELECT track_id, count(*) AS n FROM ft WHERE quality = 'sufficient' GROUP BY track_id) SELECT count(*) AS tracks, sum(n)::BIGINT AS windows, round(max(n) / sum(n), 6) AS max_track_share, round(432000 / 86400.0, 6)::DOUBLE AS overlap_factor, CASE WHEN count(*) >= 10 AND max(n) / sum(n) <= 0.2 THEN 'ready' ELSE 'not_ready' END AS readiness FROM c")
def cohort_share(spark, sf_dir):
    n = window_features(spark, sf_dir).where("quality = 'sufficient'").groupBy("track_id").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return n.agg(F.count("*").alias("tracks"), F.sum("n").alias("windows"), F.round(share, 6).alias("max_track_share"), F.lit(CFG.window_s / CFG.stride_s).alias("overlap_factor"), F.when((F.count("*") >= 10) & (share <= 0.2), "ready").otherwise("not_ready").alias("readiness"))


@query("AG43_reporting_interval", "WITH l AS (SELECT track_id, sog, t - lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS g FROM fixes) SELECT track_id, round(quantile_cont(g, 0.5), 3) AS median_interval, quantile_cont(g, 0.5) >= 3000 AS is_hourly, avg(CASE WHEN sog IS NULL THEN 0.0 ELSE 1.0 END) > 0.5 AS has_speed FROM l GROUP BY track_id")
def reporting_interval(spark, sf_dir):
    g = F.percentile("gap", 0.5)
    return T.with_gaps(fixes(spark, sf_dir)).groupBy("track_id").agg(F.round(g, 3).alias("median_interval"), (g >= 3000).alias("is_hourly"), (F.avg(F.col("sog").isNotNull().cast("double")) > 0.5).alias("has_speed"))


@query("SC1_leg_distances", "WITH l AS (SELECT *, lag(latitude) OVER p AS la, lag(longitude) OVER p AS lo FROM fixes WINDOW p AS (PARTITION BY track_id ORDER BY t, event_id)) SELECT event_id, round(" + haversine("la", "lo", "latitude", "longitude") + " / 1852, 6) AS nm FROM l")
def leg_distances(spark, sf_dir):
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    nm = geo.haversine_nm(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return fixes(spark, sf_dir).select("event_id", F.round(nm, 6).alias("nm"))


@query("SC3_course_changes", "WITH l AS (SELECT event_id, cog, lag(cog) OVER (PARTITION BY track_id ORDER BY t, event_id) AS p FROM fixes) SELECT event_id, (((cog - p + 180) % 360) + 360) % 360 - 180 AS turn FROM l")
def course_changes(spark, sf_dir):
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    return fixes(spark, sf_dir).select("event_id", geo.circular_difference(F.lag("cog").over(w), F.col("cog")).alias("turn"))


@query(
    "SC6_bearings",
    """WITH l AS (SELECT event_id, latitude, longitude, lag(latitude) OVER p AS la, lag(longitude) OVER p AS lo FROM fixes WINDOW p AS (PARTITION BY track_id ORDER BY t, event_id)),
    b AS (SELECT event_id, degrees(atan2(sin(radians(longitude - lo)) * cos(radians(latitude)), cos(radians(la)) * sin(radians(latitude)) - sin(radians(la)) * cos(radians(latitude)) * cos(radians(longitude - lo)))) AS d FROM l)
    SELECT event_id, round(((d % 360) + 360) % 360, 5) AS bearing FROM b""",
)
def bearings(spark, sf_dir):
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    b = geo.bearing_deg(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return fixes(spark, sf_dir).select("event_id", F.round(b, 5).alias("bearing"))


@query(
    "SC24_dead_reckoning",
    """WITH d AS (SELECT event_id, latitude, longitude, sog, cog, least(greatest((event_id % 300) * 1.0e0, 0), 120) * sog * (1852 / 3600.0e0) / 6371000.0e0 AS d, radians(cog) AS b, radians(latitude) AS p FROM fixes),
    e AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS q FROM d)
    SELECT event_id, round(CASE WHEN sog > 0.1 AND cog IS NOT NULL THEN degrees(q) ELSE latitude END, 7) AS lat, round(CASE WHEN sog > 0.1 AND cog IS NOT NULL THEN degrees(radians(longitude) + atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))) ELSE longitude END, 7) AS lon FROM e""",
)
def dead_reckoning(spark, sf_dir):
    lat, lon = geo.dead_reckoned(F.col("latitude"), F.col("longitude"), F.col("sog"), F.col("cog"), (F.col("event_id") % 300) * 1.0)
    return fixes(spark, sf_dir).select("event_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(
    "SC9_estimated_speed",
    """WITH l AS (SELECT event_id, track_id, t, t - lag(t) OVER p AS dt, row_number() OVER p AS r, """ + haversine("lag(latitude) OVER p", "lag(longitude) OVER p", "latitude", "longitude") + """ / 1852 AS nm FROM fixes WINDOW p AS (PARTITION BY track_id ORDER BY t, event_id)),
    v AS (SELECT *, CASE WHEN dt > 0 AND dt <= 7200 THEN least(nm / dt * 3600, 60) END AS v FROM l)
    SELECT event_id, round(CASE WHEN r = 1 THEN lead(v) OVER (PARTITION BY track_id ORDER BY t, event_id) ELSE v END, 5) AS kn FROM v""",
)
def estimated_speed(spark, sf_dir):
    """Speed by displacement, at most 60 kn, none across two hours or more; the first report takes the second's."""
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    df = T.with_gaps(fixes(spark, sf_dir)).withColumn("nm", geo.haversine_nm(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude")))
    df = df.withColumn("v", F.when((F.col("gap") > 0) & (F.col("gap") <= 7200), F.least(F.col("nm") / F.col("gap") * 3600, F.lit(60.0)))).withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("v").over(w))
    return df.select("event_id", F.round(F.when(F.col("r") == 1, F.col("second")).otherwise(F.col("v")), 5).alias("kn"))


@query(
    "F16_identity_rules",
    r"""WITH m AS (SELECT DISTINCT o_custkey AS k, CAST(o_custkey * 7654321 % 999999999 AS VARCHAR) AS mmsi FROM orders),
    d AS (SELECT *, list_max(list_transform(range(10), lambda x: length(mmsi) - length(replace(mmsi, CAST(x AS VARCHAR), '')))) AS rep FROM m)
    SELECT mmsi, regexp_full_match(mmsi, '\d{9}') AND CAST(substr(mmsi, 1, 3) AS INT) BETWEEN 201 AND 775 AND rep < 6 AS mid, regexp_full_match(mmsi, '[2-7]\d{8}') AND rep < 6 AS vessel,
    regexp_full_match(mmsi, '\d{9}') AND rep < 9 AND mmsi <> '123456789' AS plausible, regexp_full_match(mmsi, '[0-9]{9}') AS nine FROM d""",
    views=False,
)
def identity_rules(spark, sf_dir):
    m = F.col("mmsi")
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 7654321 % 999999999).cast("string").alias("mmsi")).distinct()
    return df.select("mmsi", identity.valid_mid(m).alias("mid"), identity.vessel_mmsi(m).alias("vessel"), identity.plausible_mmsi(m).alias("plausible"), identity.nine_digits(m).alias("nine"))


@query(
    "F19_imo_checksum",
    """WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS imo FROM orders)
    SELECT o_orderkey, (CAST(imo[1] AS INT) * 7 + CAST(imo[2] AS INT) * 6 + CAST(imo[3] AS INT) * 5 + CAST(imo[4] AS INT) * 4 + CAST(imo[5] AS INT) * 3 + CAST(imo[6] AS INT) * 2) % 10 = CAST(imo[7] AS INT) AS valid FROM d""",
    views=False,
)
def imo_checksum(spark, sf_dir):
    imo = F.lpad((F.col("o_orderkey") * 7919 % 10000000).cast("string"), 7, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.imo_valid(F.concat(F.lit("IMO "), imo)).alias("valid"))
