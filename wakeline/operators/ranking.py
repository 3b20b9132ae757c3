"""Ranking of windows for review: reference profiles, mid-ranks, scores, ranks, reasons, and comparison of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.operators.ranges import percentiles, row_numbers, running_sum


def reference_profile(long: DataFrame) -> DataFrame:
    """(feature, n, p25, median, p75, mad, scale, rule) of (feature, value): scale by quartiles, else by MAD, else inactive."""
    base = percentiles(long, ["feature"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    base = long.where("value is not null").groupBy("feature").agg(F.count("*").alias("n")).join(base, "feature")
    off = long.where("value is not null").join(base.select("feature", "median"), "feature").select("feature", F.abs(F.col("value") - F.col("median")).alias("off"))
    out = base.join(percentiles(off, ["feature"], "off", {"mad": 0.5}), "feature")
    iqr, dev = (F.col("p75") - F.col("p25")) / 1.349, 1.4826 * F.col("mad")
    return out.withColumns({"scale": F.when(iqr > 0, iqr).when(dev > 0, dev), "rule": F.when(iqr > 0, "iqr").when(dev > 0, "mad").otherwise("inactive")})


def midranks(reference: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """queries (keys, value, ...) with p = (smaller + half the equal) / n within the reference values of the same keys.

    All values are counted first; running counts over ranges of them, then one equi-join by value: no query meets the whole reference,
    and no task holds a whole feature.
    """
    ref = reference.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("_m"))
    asked = queries.where("value is not null").select(*keys, "value", F.lit(0).cast("long").alias("_m"))
    values = ref.select(*keys, "value", "_m").unionByName(asked).groupBy(*keys, "value").agg(F.sum("_m").alias("_m"))
    values = running_sum(values, keys, [F.col("value").asc()], "_m", "_less")
    total = ref.groupBy(*keys).agg(F.sum("_m").alias("_total"))
    p = F.when(F.col("_total") > 0, (F.col("_less") + 0.5 * F.col("_m")) / F.col("_total"))
    return queries.join(values.join(total, keys).select(*keys, "value", p.alias("p")), [*keys, "value"], "left").select(*queries.columns, "p")


def best_two(scores: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """70 % of the largest group's score plus 30 % of the second largest's; a group's score is its largest feature's."""
    top = scores.groupBy(*keys, group).agg(F.max(value).alias("_g")).groupBy(*keys).agg(F.sort_array(F.collect_list("_g"), asc=False).alias("_s"))
    return top.select(*keys, (0.7 * F.col("_s")[0] + 0.3 * F.coalesce(F.get("_s", F.lit(1)), F.lit(0.0))).alias("score"))


def rank(scores: DataFrame, score: str, tie: list[str], budget: int, keep: int | None = None) -> DataFrame:
    """Adds rank by score, ties in the given order, and whether it is within the budget; with cutoff_tie where the score equals the last one in.

    keep: only so many of the first rows are wanted, by a bounded sort; else every row is ranked, over ranges of one sort.
    """
    order = [F.desc(score), *[F.col(c).asc() for c in tie]]
    if keep is not None:
        out = scores.orderBy(*order).limit(keep).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))  # keep rows
        edge = F.min(F.when(F.col("rank") <= budget, F.col(score))).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return out.withColumn("shortlisted", F.col("rank") <= budget).withColumn("cutoff_tie", F.col(score) == edge)
    out = row_numbers(scores, order).withColumn("shortlisted", F.col("rank") <= budget)
    edge = out.where("shortlisted").agg(F.min(score).alias("_edge"))  # one row
    return out.crossJoin(F.broadcast(edge)).withColumn("cutoff_tie", F.col(score) == F.col("_edge")).drop("_edge")


def top_reasons(components: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Per key the k largest components (feature, group, value), one a group at most, ties by name, as (reason, feature, value)."""
    one = F.row_number().over(W.partitionBy(*keys, "group").orderBy(F.desc("value"), "feature"))
    top = components.where("value is not null").withColumn("_r", one).where("_r = 1")
    order = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), "feature"))
    return top.withColumn("reason", order).where(F.col("reason") <= k).select(*keys, "reason", "feature", "value")


def compare(a: DataFrame, b: DataFrame, key: str, budgets: tuple[int, ...]) -> DataFrame:
    """One row: Jaccard of the first k of two rankings (key, rank, score), rank correlation, and mean score change."""
    both = a.select(key, F.col("rank").alias("ra"), F.col("score").alias("sa")).join(b.select(key, F.col("rank").alias("rb"), F.col("score").alias("sb")), key)

    def jaccard(k: int) -> Column:
        x, y = F.col("ra") <= k, F.col("rb") <= k
        return (F.count_if(x & y) / F.count_if(x | y)).alias(f"jaccard_{k}")

    return both.agg(*[jaccard(k) for k in budgets], F.corr("ra", "rb").alias("rank_correlation"), F.avg(F.abs(F.col("sa") - F.col("sb"))).alias("mean_change"))


def roc_auc(df: DataFrame, label: Column, score: Column, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from average ranks: (R+ - n+ (n+ + 1) / 2) / (n+ n-).

    Scores are counted by value first, so ties cost one row and the running count runs over distinct scores.
    """
    keys = keys or []
    c = df.select(*keys, label.cast("int").alias("_y"), score.alias("_s")).where("_y is not null and _s is not null").groupBy(*keys, "_s").agg(F.sum("_y").alias("_p"), F.count("*").alias("_n"))
    c = running_sum(c, keys, [F.col("_s").asc()], "_n", "_below").withColumn("_mean", F.col("_below") + (F.col("_n") + 1) / 2)
    pos, neg = F.sum("_p"), F.sum(F.col("_n") - F.col("_p"))
    return c.groupBy(*keys).agg(pos.alias("positives"), neg.alias("negatives"), F.try_divide(F.sum(F.col("_p") * F.col("_mean")) - pos * (pos + 1) / 2, (pos * neg).cast("double")).alias("auc"))
