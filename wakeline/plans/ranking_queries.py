"""Queries for ranking windows, comparing rankings, and evaluating scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import ranking as R
from wakeline.operators import tracks as T
from wakeline.plans.registry import query
from wakeline.plans.track_queries import _LONG, WIN, window_features
from wakeline.scratch import Scratch
from wakeline.sources.fixes import table

#: Features in groups: at most one reason a group.
GROUPS = {"sog_median": "speed", "sog_p95": "speed", "low_speed_fraction": "speed", "low_speed_s": "speed", "path_m": "path", "displacement_m": "path", "path_ratio": "path", "turn_sum": "turning", "turn_p95": "turning", "drift_median": "drift"}
LONG = "WITH " + WIN + f", x0 AS ({_LONG.replace('AS feature,', 'AS feature, segment_id, window_ordinal, ')}), x AS (SELECT feature, segment_id, window_ordinal, round(v, 5) AS v FROM x0)"
GROUP_SQL = "CASE " + " ".join(f"WHEN feature = '{f}' THEN '{g}'" for f, g in GROUPS.items()) + " END"
MID = LONG + """, r AS (SELECT feature, v, count(*) OVER (PARTITION BY feature) AS n, rank() OVER (PARTITION BY feature ORDER BY v) - 1 AS less, count(*) OVER (PARTITION BY feature, v) AS eq, segment_id, window_ordinal FROM x WHERE v IS NOT NULL),
m AS (SELECT *, (less + 0.5e0 * eq) / n AS p FROM r), c AS (SELECT *, 2 * abs(p - 0.5e0) AS value, """ + GROUP_SQL + """ AS grp FROM m)"""
SCORE = MID + ", gs AS (SELECT segment_id, window_ordinal, grp, max(value) AS g FROM c GROUP BY ALL), ls AS (SELECT segment_id, window_ordinal, list_sort(list(g), 'DESC') AS l FROM gs GROUP BY ALL), sc AS (SELECT segment_id, window_ordinal, 0.7e0 * l[1] + 0.3e0 * coalesce(l[2], 0) AS score FROM ls)"


def long_features(spark, sf_dir):
    """A row for each window and feature, written once: profiles and ranks read it several times."""
    long = window_features(spark, sf_dir).select("segment_id", "window_ordinal", *T.FEATURES).unpivot(["segment_id", "window_ordinal"], list(T.FEATURES), "feature", "value").withColumn("value", F.round("value", 5))
    return Scratch(spark, "features").save(long, "long")


def components(spark, sf_dir):
    long = long_features(spark, sf_dir)
    p = R.midranks(long, long.where("value is not null"), ["feature"])
    group = F.element_at(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv]), F.col("feature"))
    return p.select("segment_id", "window_ordinal", "feature", group.alias("group"), "p", (2 * F.abs(F.col("p") - 0.5)).alias("value"))


def scores(spark, sf_dir):
    return R.best_two(components(spark, sf_dir), ["segment_id", "window_ordinal"], "group", "value")


@query("AG22_reference_profile", LONG + ", bs AS (SELECT feature, count(v) AS n, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75 FROM x WHERE v IS NOT NULL GROUP BY feature), d AS (SELECT feature, quantile_cont(abs(v - median), 0.5) AS mad FROM x JOIN bs USING (feature) WHERE v IS NOT NULL GROUP BY feature) SELECT feature, n, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75, round(mad, 4) AS mad, round(CASE WHEN p75 > p25 THEN (p75 - p25) / 1.349e0 WHEN mad > 0 THEN 1.4826e0 * mad END, 4) AS scale, CASE WHEN p75 > p25 THEN 'iqr' WHEN mad > 0 THEN 'mad' ELSE 'inactive' END AS rule FROM bs JOIN d USING (feature)")
def reference_profile(spark, sf_dir):
    out = R.reference_profile(long_features(spark, sf_dir))
    return out.select("feature", "n", *[F.round(c, 4).alias(c) for c in ("p25", "median", "p75", "mad", "scale")], "rule")


@query("AG23_feature_support", LONG + " SELECT feature, count(v) AS n, round(count(v) / count(*), 6) AS fraction, count(DISTINCT v) AS distinct_values, CASE WHEN count(v) >= 100 AND count(v) / count(*) >= 0.5 AND count(DISTINCT v) >= 10 THEN 'supported' WHEN count(v) >= 30 THEN 'weak' ELSE 'unsupported' END AS tier FROM x GROUP BY feature")
def feature_support(spark, sf_dir):
    long = long_features(spark, sf_dir)
    n, share, kinds = F.count("value"), F.count("value") / F.count("*"), F.count_distinct("value")
    return long.groupBy("feature").agg(n.alias("n"), F.round(share, 6).alias("fraction"), kinds.alias("distinct_values"), F.when((n >= 100) & (share >= 0.5) & (kinds >= 10), "supported").when(n >= 30, "weak").otherwise("unsupported").alias("tier"))


@query("WN14_midranks", MID + " SELECT segment_id, window_ordinal, feature, round(p, 6) AS p FROM m")
def midranks(spark, sf_dir):
    return components(spark, sf_dir).select("segment_id", "window_ordinal", "feature", F.round("p", 6).alias("p"))


@query("SC13_percentile_score", SCORE + " SELECT segment_id, window_ordinal, round(score, 6) AS score FROM sc")
def percentile_score(spark, sf_dir):
    return scores(spark, sf_dir).select("segment_id", "window_ordinal", F.round("score", 6).alias("score"))


@query("WN13_review_list", SCORE + ", z AS (SELECT *, round(score, 9) AS rs FROM sc), k AS (SELECT segment_id, window_ordinal, rs, row_number() OVER (ORDER BY rs DESC, segment_id, window_ordinal) AS rank FROM z), e AS (SELECT *, min(CASE WHEN rank <= 20 THEN rs END) OVER () AS edge FROM k) SELECT segment_id, window_ordinal, rank, round(rs, 6) AS score, rs = edge AS cutoff_tie FROM e WHERE rank <= 50")
def review_list(spark, sf_dir):
    ranked = R.rank(scores(spark, sf_dir).withColumn("score", F.round("score", 9)), "score", ["segment_id", "window_ordinal"], 20, keep=50)
    return ranked.where("rank <= 50").select("segment_id", "window_ordinal", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "cutoff_tie")


@query("SO3_top_reasons", MID + ", z AS (SELECT *, round(value, 9) AS rv FROM c)  , og AS (SELECT *, row_number() OVER (PARTITION BY segment_id, window_ordinal, grp ORDER BY rv DESC, feature) AS r FROM z), qr AS (SELECT *, row_number() OVER (PARTITION BY segment_id, window_ordinal ORDER BY rv DESC, feature) AS reason FROM og WHERE r = 1) SELECT segment_id, window_ordinal, reason, feature, round(rv, 6) AS value FROM qr WHERE reason <= 3")
def top_reasons(spark, sf_dir):
    c = components(spark, sf_dir).withColumn("value", F.round("value", 9))
    out = R.top_reasons(c, ["segment_id", "window_ordinal"])
    return out.select("segment_id", "window_ordinal", F.col("reason").cast("long").alias("reason"), "feature", F.round("value", 6).alias("value"))


@query("AG25_ranking_agreement", "WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS ra, p_retailprice / 1000.0e0 AS sa FROM part), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rb, p_size / 10.0e0 AS sb FROM part), j AS (SELECT * FROM a JOIN b USING (p_partkey)) SELECT round(sum(CASE WHEN ra <= 50 AND rb <= 50 THEN 1 ELSE 0 END) / sum(CASE WHEN ra <= 50 OR rb <= 50 THEN 1 ELSE 0 END), 6) AS jaccard_50, round(sum(CASE WHEN ra <= 500 AND rb <= 500 THEN 1 ELSE 0 END) / sum(CASE WHEN ra <= 500 OR rb <= 500 THEN 1 ELSE 0 END), 6) AS jaccard_500, round(corr(ra, rb), 6) AS rank_correlation, round(avg(abs(sa - sb)), 6) AS mean_change FROM j", views=False)
def ranking_agreement(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a = R.rank(part.select("p_partkey", (F.col("p_retailprice") / 1000.0).alias("score")), "score", ["p_partkey"], 50)
    b = R.rank(part.select("p_partkey", (F.col("p_size") / 10.0).alias("score")), "score", ["p_partkey"], 50)
    out = R.compare(a, b, "p_partkey", (50, 500))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("U4_roc_auc", "WITH d AS (SELECT source, quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0e0 AS ar FROM d), g AS (SELECT source, sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives, sum(y * ar) AS rp FROM r GROUP BY source) SELECT source, positives, negatives, round((rp - positives * (positives + 1) / 2.0e0) / (positives * negatives), 6) AS auc FROM g WHERE positives > 0 AND negatives > 0", views=False)
def auc_by_source(spark, sf_dir):
    """How well text length alone tells quality, by source."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    out = R.roc_auc(d, F.col("quality"), F.col("n_chars"), ["source"]).where("positives > 0 and negatives > 0")
    return out.select("source", "positives", "negatives", F.round("auc", 6).alias("auc"))


@query("D20_threshold_sweep", "WITH d AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT unnest([100, 300, 1000, 3000, 10000]) AS cut) SELECT cut, count(*) AS flagged, sum(y)::BIGINT AS hits, round(sum(y) / count(*), 6) AS precision, round(sum(y) / (SELECT sum(y) FROM d), 6) AS recall FROM d JOIN c ON s >= cut GROUP BY cut", views=False)
def threshold_sweep(spark, sf_dir):
    """Flags, precision and recall at each of a few cuts."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    cuts = [100, 300, 1000, 3000, 10000]
    wide = d.select("quality", F.explode(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("n_chars"))).alias("cut"))
    total = d.agg(F.sum("quality").alias("total"))
    out = wide.groupBy("cut").agg(F.count("*").alias("flagged"), F.sum("quality").alias("hits")).crossJoin(F.broadcast(total))
    return out.select("cut", "flagged", "hits", F.round(F.col("hits") / F.col("flagged"), 6).alias("precision"), F.round(F.col("hits") / F.col("total"), 6).alias("recall"))
