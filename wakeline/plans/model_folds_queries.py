"""Query of the path classifier over vessel-days, out of fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import path_model as M
from wakeline.plans.registry import query
from wakeline.plans.resampling_queries import track_days
from wakeline.sources.fixes import fixes

FEATURES = ["speed", "north", "east", "n"]


@query("U9_path_classifier")
def path_classifier(spark, sf_dir):
    """How much each vessel's two days look like days with a declared rest at speed, by models of other vessels."""
    wide = track_days(spark, sf_dir).groupBy("track_id", "day").pivot("feature", FEATURES).agg(F.first("value"))
    rest = F.max((F.col("status").isin(1, 5, 6) & (F.col("sog") >= 3)).cast("int"))
    label = fixes(spark, sf_dir).groupBy("track_id", F.floor(F.col("t") / 172_800).alias("day")).agg(F.coalesce(rest, F.lit(0)).alias("label"))
    out = M.out_of_fold_scores(wide.join(label, ["track_id", "day"]), FEATURES, "label", "track_id")
    return out.select("track_id", "day", "fold", "label", F.round("score", 6).alias("score"))
