"""Resampling by hash: track bootstrap, folds that keep groups whole, and permuted columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.operators.ranges import percentiles, row_numbers, running_sum
from wakeline.scratch import Scratch


def hashed(*parts: Column) -> Column:
    """A number below 2**32 from an MD5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def draws(tracks: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, key, weight): how often each replicate draws each track, with replacement, as many as there are.

    Tracks are numbered over ranges of one sort; each of a replicate's slots picks a number by hash.
    """
    numbered = Scratch(tracks.sparkSession, "draws").save(row_numbers(tracks.select(key).distinct(), [F.col(key).asc()], "_number"), "tracks")
    n = numbered.count()
    slots = numbered.select((F.col("_number") - 1).alias("_slot")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    picked = slots.select("replicate", (hashed(F.lit(seed), F.col("replicate"), F.col("_slot")) % n + 1).alias("_number"))
    counted = picked.groupBy("replicate", "_number").agg(F.count("*").alias("weight"))
    return counted.join(numbered, "_number").select("replicate", key, "weight")


def bootstrap_overlap(long: DataFrame, item: list[str], key: str, replicates: int, seed: int, k: int) -> DataFrame:
    """(replicate, overlap): Jaccard of the k strangest items under each replicate's reference with the k under the whole reference.

    long: (key, *item, feature, value).  An item's strangeness is its mean distance from the feature's median in units of the quartiles'
    spread.  A replicate refits both on its tracks, as often as it draws them: weights, so no row is copied.
    """
    scratch = Scratch(long.sparkSession, "bootstrap")
    long = scratch.save(long.where("value is not null"), "long")
    weights = draws(long, key, replicates, seed).select(F.col(key).alias("_key"), "replicate", "weight")
    whole = long.select("feature", "value", F.lit(-1).alias("replicate"), F.lit(1).cast("long").alias("weight"))
    drawn = long.join(weights, F.col(key) == F.col("_key")).select("feature", "value", "replicate", "weight")
    fitted = percentiles(whole.union(drawn), ["replicate", "feature"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75}, weight="weight")
    fitted = scratch.save(fitted.select("replicate", F.col("feature").alias("_f"), "median", ((F.col("p75") - F.col("p25")) / 1.349).alias("scale")), "fitted")
    off = F.when(F.col("scale") > 0, F.abs(F.col("value") - F.col("median")) / F.col("scale"))
    scored = long.join(fitted, F.col("feature") == F.col("_f")).groupBy("replicate", *item).agg(F.round(F.avg(off), 9).alias("score"))
    first = F.row_number().over(W.partitionBy("replicate").orderBy(F.desc_nulls_last("score"), *item))
    top = scratch.save(scored.withColumn("_r", first).where(F.col("_r") <= k).select("replicate", *item), "top")
    base = top.where("replicate = -1").drop("replicate")
    common = top.where("replicate >= 0").join(F.broadcast(base), item, "left_semi").groupBy("replicate").agg(F.count("*").alias("_c"))  # k rows
    sizes = top.where("replicate >= 0").groupBy("replicate").agg(F.count("*").alias("_n"))
    size = base.count()
    c = F.coalesce("_c", F.lit(0))
    return sizes.join(common, "replicate", "left").select("replicate", (c / (F.col("_n") + size - c)).alias("overlap"))


def grouped_folds(rows: DataFrame, group: str, label: str, folds: int, seed: int) -> DataFrame:
    """rows with fold: all rows of a group in one, and groups with and without a true label spread evenly over the folds."""
    groups = rows.groupBy(F.col(group).alias("_g")).agg(F.max(F.col(label).cast("int")).alias("_y")).withColumn("_h", hashed(F.lit(seed), F.col("_g")))
    before = running_sum(groups.withColumn("_one", F.lit(1).cast("long")), ["_y"], [F.col("_h").asc(), F.col("_g").asc()], "_one", "_before")
    # strata begin at different folds, so that small ones don't all end in the first
    fold = ((F.col("_before") + F.coalesce("_y", F.lit(0))) % folds).cast("int")
    return rows.join(before.select("_g", fold.alias("fold")), F.col(group) == F.col("_g")).drop("_g")


def out_of_fold_rate(rows: DataFrame, by: str, label: str) -> DataFrame:
    """rows (with fold) with rate: the share of true labels among rows of the same value of `by` in all other folds, else of all other folds."""
    y = F.col(label).cast("double")
    each = rows.groupBy(F.col(by).alias("_by"), F.col("fold").alias("_fold")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    w, all_ = W.partitionBy("_by"), W.partitionBy()
    folds = each.groupBy("_fold").agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))  # a row a fold
    folds = folds.withColumn("_rest", (F.sum("_fs").over(all_) - F.col("_fs")) / (F.sum("_fn").over(all_) - F.col("_fn"))).select(F.col("_fold").alias("_k"), "_rest")
    left_s, left_n = F.sum("_s").over(w) - F.col("_s"), F.sum("_n").over(w) - F.col("_n")
    each = each.join(F.broadcast(folds), F.col("_fold") == F.col("_k"))
    each = each.select("_by", "_fold", F.when(left_n > 0, left_s / left_n).otherwise(F.col("_rest")).alias("rate"))
    return rows.join(each, F.col(by).eqNullSafe(F.col("_by")) & (F.col("fold") == F.col("_fold"))).drop("_by", "_fold")


def permuted(rows: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """rows with the column's values dealt out anew: the n-th row by key gets the value of the n-th row by hash of key.

    Two range sorts and a join by number; no task sorts all rows.  key tells rows apart.
    """
    plain = row_numbers(rows, [F.col(key).asc()], "_n")
    dealt = row_numbers(rows.select(F.col(key).alias("_key"), F.col(column).alias("_value"), hashed(F.lit(seed), F.col(key)).alias("_h")), [F.col("_h").asc(), F.col("_key").asc()], "_m")
    out = plain.drop(column).join(dealt.select("_m", F.col("_value").alias(column)), F.col("_n") == F.col("_m"))
    return out.select(*rows.columns)


def average_precision(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the sum over distinct scores, falling, of precision so far times the recall gained; null without positives."""
    counts = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy((-F.col(score)).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n"))
    counts = running_sum(running_sum(counts, [], [F.col("_s").asc()], "_n", "_nb"), [], [F.col("_s").asc()], "_p", "_pb")
    part = F.col("_p") * (F.col("_pb") + F.col("_p")) / (F.col("_nb") + F.col("_n"))
    return counts.agg(F.try_divide(F.sum(part), F.sum("_p").cast("double")).alias("average_precision"))


def permutation_importance(rows: DataFrame, key: str, features: list[str], label: str, score: Callable[[DataFrame], DataFrame], repeats: int = 3, seed: int = 0) -> DataFrame:
    """(feature, base, importance): how much average precision is lost, on average over repeats, when a feature's values are dealt out anew.

    score adds a column score to rows.  There are as many passes as features times repeats, and each is spread over the cluster.
    """
    rows = Scratch(rows.sparkSession, "importance").save(rows, "rows")
    base = average_precision(score(rows), label, "score").first()[0]
    parts = []
    for f in features:
        for k in range(repeats):
            lost = average_precision(score(permuted(rows, key, f, seed + k)), label, "score").first()[0]
            parts.append((f, None if base is None or lost is None else base - lost))
    table = rows.sparkSession.createDataFrame(parts, "feature string, lost double")  # a row a feature and repeat
    return table.groupBy("feature").agg(F.avg("lost").alias("importance")).select("feature", F.lit(base).cast("double").alias("base"), "importance")
