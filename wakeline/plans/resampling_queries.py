"""Queries of identity reconciliation, track bootstrap, grouped folds and permutation importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import ranking as R
from wakeline.operators import reconcile as C
from wakeline.operators import resampling as S
from wakeline.plans.registry import query
from wakeline.sources.fixes import fixes, table

#: Provider rows: each vessel's reports under a uuid that some share, some change and some lack, with MMSIs that some lack or get wrong.
PROVIDER = """pv AS (SELECT event_id, t, latitude, longitude, CASE WHEN event_id % 5 < 2 THEN NULL WHEN user_id % 10 = 0 THEN 'u' || (user_id % 20) WHEN user_id % 10 = 3 AND event_id % 3 = 0 THEN 'x' || user_id ELSE 'u' || (1000 + user_id) END AS uuid,
CASE WHEN event_id % 11 = 0 OR user_id % 10 = 7 THEN NULL WHEN user_id % 10 = 5 AND event_id % 13 = 0 THEN 12345 ELSE 416000000 + user_id END AS mmsi, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 9000000 + user_id END AS imo FROM fixes)"""


def provider_rows(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    uuid = F.when(e % 5 < 2, None).when(u % 10 == 0, name("u", u % 20)).when((u % 10 == 3) & (e % 3 == 0), name("x", u)).otherwise(name("u", 1000 + u))
    mmsi = F.when((e % 11 == 0) | (u % 10 == 7), None).when((u % 10 == 5) & (e % 13 == 0), 12345).otherwise(416_000_000 + u)
    return fixes(spark, sf_dir).select(e, "t", "latitude", "longitude", uuid.alias("uuid"), mmsi.cast("long").alias("mmsi"), F.when(e % 4 != 0, 9_000_000 + u).alias("imo"))


@query(
    "J25_reconciled_vessels",
    "WITH " + PROVIDER + ", ok AS (SELECT *, CASE WHEN mmsi BETWEEN 100000000 AND 999999999 THEN mmsi END AS m, sha256(coalesce(imo::VARCHAR, '') || '|' || event_id) AS fp FROM pv), us AS (SELECT m, count(DISTINCT uuid) AS n, min(uuid) AS only_one FROM ok WHERE uuid IS NOT NULL AND m IS NOT NULL GROUP BY m), ky AS (SELECT ok.*, coalesce(us.n, 0) AS uses, CASE WHEN uuid IS NOT NULL THEN 'uuid' WHEN ok.m IS NOT NULL THEN CASE coalesce(us.n, 0) WHEN 1 THEN 'uuid' WHEN 0 THEN 'mmsi' ELSE 'ambiguous' END WHEN imo IS NOT NULL THEN 'imo' ELSE 'fallback' END AS kind, CASE WHEN uuid IS NOT NULL THEN uuid WHEN ok.m IS NOT NULL THEN CASE coalesce(us.n, 0) WHEN 1 THEN only_one WHEN 0 THEN ok.m::VARCHAR ELSE fp END WHEN imo IS NOT NULL THEN imo::VARCHAR ELSE fp END AS value FROM ok LEFT JOIN us ON us.m = ok.m)"
    " SELECT kind, value, CASE WHEN count(DISTINCT m) = 1 AND count(*) FILTER (WHERE mmsi IS NOT NULL AND m IS NULL) = 0 AND max(CASE WHEN m IS NOT NULL THEN uses END) <= 1 THEN min(m) END AS trusted_mmsi, count(*) AS n, arg_max(event_id, (t, event_id)) AS event_id FROM ky GROUP BY kind, value",
)
def reconciled(spark, sf_dir):
    """One row a vessel from provider rows with contradicting identities."""
    rows = provider_rows(spark, sf_dir)
    valid = F.coalesce(F.col("mmsi").between(100_000_000, 999_999_999), F.lit(False))
    out = C.reconcile(rows, valid, C.fingerprint(F.col("imo"), F.col("event_id")), F.struct("t", "event_id"))
    return out.select("kind", "value", "trusted_mmsi", "n", F.col("latest.event_id").alias("event_id"))


REPLICATES, SEED, TOP = 20, 42, 20
DAYS = "dy AS (SELECT track_id, CAST(floor(t / 172800) AS BIGINT) AS day, sum(CAST(round(sog * 10) AS BIGINT)) / 10.0e0 / count(sog) AS speed, max(latitude) - min(latitude) AS north, max(longitude) - min(longitude) AS east, count(*)::DOUBLE AS n FROM fixes GROUP BY ALL), lo AS (SELECT track_id, day, unnest(['speed', 'north', 'east', 'n']) AS feature, unnest([round(speed, 6), round(north, 6), round(east, 6), n]) AS value FROM dy), lg AS (SELECT * FROM lo WHERE value IS NOT NULL)"
HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


def track_days(spark, sf_dir):
    """Four features of each vessel and two days, a row each."""
    f = fixes(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 172_800))
    spread = lambda c: F.round(F.max(c) - F.min(c), 6)
    speed = F.round(F.sum(F.round(F.col("sog") * 10).cast("long")) / F.lit(10.0) / F.nullif(F.count("sog"), F.lit(0)), 6)
    wide = f.groupBy("track_id", "day").agg(speed.alias("speed"), spread("latitude").alias("north"), spread("longitude").alias("east"), F.count("*").cast("double").alias("n"))
    return wide.unpivot(["track_id", "day"], ["speed", "north", "east", "n"], "feature", "value")


@query(
    "AG26_track_bootstrap",
    "WITH " + DAYS + f", tr AS (SELECT track_id, row_number() OVER (ORDER BY track_id) AS num FROM (SELECT DISTINCT track_id FROM lg)), dr AS (SELECT replicate, " + HASH.format(f"'{SEED}:' || replicate || ':' || (num - 1)") + f" % (SELECT count(*) FROM tr) + 1 AS num FROM tr CROSS JOIN (SELECT unnest(range(0, {REPLICATES})) AS replicate)),"
    " rf AS (SELECT -1 AS replicate, feature, value FROM lg UNION ALL SELECT dr.replicate, feature, value FROM dr JOIN tr USING (num) JOIN lg USING (track_id)), ft AS (SELECT replicate, feature, quantile_cont(value, 0.5) AS med, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349e0 AS sc FROM rf GROUP BY ALL),"
    f" sd AS (SELECT replicate, track_id, day, round(avg(CASE WHEN sc > 0 THEN abs(value - med) / sc END), 9) AS score FROM lg JOIN ft USING (feature) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY score DESC NULLS LAST, track_id, day) AS r FROM sd), tp AS (SELECT * FROM rk WHERE r <= {TOP}), cm AS (SELECT a.replicate, count(b.track_id) AS c, count(*) AS n FROM tp a LEFT JOIN tp b ON b.replicate = -1 AND a.track_id = b.track_id AND a.day = b.day WHERE a.replicate >= 0 GROUP BY a.replicate), ov AS (SELECT replicate, c / (n + (SELECT count(*) FROM tp WHERE replicate = -1) - c) AS overlap FROM cm)"
    " SELECT count(*) AS replicates, round(median(overlap), 6) AS median_overlap, round(min(overlap), 6) AS least_overlap FROM ov",
)
def track_bootstrap(spark, sf_dir):
    """How stable the twenty strangest vessel-days are when whole vessels are drawn anew."""
    out = S.bootstrap_overlap(track_days(spark, sf_dir), ["track_id", "day"], "track_id", REPLICATES, SEED, TOP)
    return out.agg(F.count("*").alias("replicates"), F.round(F.percentile("overlap", 0.5), 6).alias("median_overlap"), F.round(F.min("overlap"), 6).alias("least_overlap"))  # a row a replicate


FOLDED = "gr AS (SELECT user_id, max(CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 ELSE 0 END) AS y0 FROM events GROUP BY user_id), hs AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE y0 END AS y, " + HASH.format("'7:' || user_id") + " AS h FROM gr), fo AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY h, user_id) - 1 + y) % 5 AS fold FROM hs)"


def labelled_vessels(spark, sf_dir):
    """A row a vessel: its type and whether it is listed."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), 1).otherwise(0)).alias("y0"))
    return e.select("user_id", F.when(F.col("user_id") % 4 == 0, 0).otherwise(F.col("y0")).alias("y"), (60 + F.col("user_id") % 30).alias("vessel_type"))


@query("U7_grouped_folds", "WITH " + FOLDED + ", rt AS (SELECT 60 + user_id % 30 AS vessel_type, fold, sum(y)::DOUBLE AS s, count(*) AS n FROM fo GROUP BY ALL), al AS (SELECT fold, (SELECT sum(s) FROM rt b WHERE b.fold <> a.fold) / (SELECT sum(n) FROM rt b WHERE b.fold <> a.fold) AS rest FROM (SELECT DISTINCT fold FROM rt) a), oo AS (SELECT f.user_id, f.fold, f.y, coalesce((SELECT sum(s) / sum(n) FROM rt b WHERE b.vessel_type = 60 + f.user_id % 30 AND b.fold <> f.fold), al.rest) AS rate FROM fo f JOIN al ON al.fold = f.fold) SELECT user_id, fold::INT AS fold, y, round(rate, 6) AS rate FROM oo")
def grouped_folds(spark, sf_dir):
    """Vessels in five folds with as many listed ones in each, and the share listed of their type in the other folds."""
    folded = S.grouped_folds(labelled_vessels(spark, sf_dir), "user_id", "y", 5, 7)
    return S.out_of_fold_rate(folded, "vessel_type", "y").select("user_id", "fold", "y", F.round("rate", 6).alias("rate"))


@query("U7_fold_scores", "WITH " + FOLDED + ", rt AS (SELECT 60 + user_id % 30 AS vessel_type, fold, sum(y)::DOUBLE AS s, count(*) AS n FROM fo GROUP BY ALL), al AS (SELECT fold, (SELECT sum(s) FROM rt b WHERE b.fold <> a.fold) / (SELECT sum(n) FROM rt b WHERE b.fold <> a.fold) AS rest FROM (SELECT DISTINCT fold FROM rt) a), oo AS (SELECT f.fold, f.y, round(coalesce((SELECT sum(s) / sum(n) FROM rt b WHERE b.vessel_type = 60 + f.user_id % 30 AND b.fold <> f.fold), al.rest), 9) AS rate FROM fo f JOIN al ON al.fold = f.fold), rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY rate) + (count(*) OVER (PARTITION BY fold, rate) - 1) / 2.0e0 AS ar FROM oo) SELECT fold::INT AS fold, sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives, round(CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * sum(1 - y)) END, 6) AS auc FROM rk GROUP BY fold")
def fold_scores(spark, sf_dir):
    """How well the type's share in other folds tells listed vessels, by fold."""
    folded = S.grouped_folds(labelled_vessels(spark, sf_dir), "user_id", "y", 5, 7)
    out = R.roc_auc(S.out_of_fold_rate(folded, "vessel_type", "y"), F.col("y"), F.round("rate", 9), ["fold"])
    return out.select("fold", "positives", "negatives", F.round("auc", 6).alias("auc"))


FEATURES = ("n_chars", "words", "marks")
IMPORTANCE = "dl AS (SELECT documents.doc_id AS k, documents.n_chars AS n_chars, length(text) - length(replace(text, ' ', '')) AS words, length(text) - length(replace(text, '#', '')) AS marks, 1 - quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL)"


@query(
    "U5_permutation_importance",
    "WITH " + IMPORTANCE + ", rp AS (SELECT NULL AS f, 0 AS rep, k, n_chars, words, marks, y FROM dl UNION ALL SELECT f, rep, a.k, CASE WHEN f = 'n_chars' THEN b.n_chars ELSE a.n_chars END, CASE WHEN f = 'words' THEN b.words ELSE a.words END, CASE WHEN f = 'marks' THEN b.marks ELSE a.marks END, a.y FROM (SELECT unnest(['n_chars', 'words', 'marks']) AS f) CROSS JOIN (SELECT unnest([0, 1, 2]) AS rep) CROSS JOIN (SELECT *, row_number() OVER (ORDER BY k) AS n FROM dl) a JOIN (SELECT rep AS rep2, dl.*, row_number() OVER (PARTITION BY rep ORDER BY " + HASH.format("rep || ':' || k") + ", k) AS n FROM dl CROSS JOIN (SELECT unnest([0, 1, 2]) AS rep)) b ON b.n = a.n AND b.rep2 = rep),"
    " sc AS (SELECT f, rep, y, marks * 4.0e0 - words * 0.01e0 + n_chars * 0.001e0 AS s FROM rp), ct AS (SELECT f, rep, s, sum(y) AS p, count(*) AS n FROM sc GROUP BY ALL), cu AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM ct WINDOW w AS (PARTITION BY f, rep ORDER BY s DESC)), ap AS (SELECT f, rep, sum(p * cp / cn) / sum(p) AS ap FROM cu GROUP BY ALL) SELECT f AS feature, round((SELECT ap FROM ap WHERE f IS NULL), 6) AS base, round((SELECT ap FROM ap WHERE f IS NULL) - avg(ap), 6) AS importance FROM ap WHERE f IS NOT NULL GROUP BY f",
    views=False,
)
def permutation_importance(spark, sf_dir):
    """What a fixed linear score of low quality loses without each of its features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").where("text is not null")
    labels = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("k"), (1 - F.col("quality")).alias("y"))
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    rows = docs.join(labels, F.col("doc_id") == F.col("k")).select("k", "n_chars", count(" ").alias("words"), count("#").alias("marks"), "y")
    score = lambda df: df.withColumn("score", F.col("marks") * 4.0 - F.col("words") * 0.01 + F.col("n_chars") * 0.001)
    out = S.permutation_importance(rows, "k", list(FEATURES), "y", score)
    return out.select("feature", F.round("base", 6).alias("base"), F.round("importance", 6).alias("importance"))
