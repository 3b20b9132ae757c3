"""Routes: resampling by arc length, and the centre line and width of a corridor learned from many tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo


def resample(df: DataFrame, anchors: int = 20) -> DataFrame:
    """(track_id, anchor, latitude, longitude): points at equal shares of each track's length.

    Each leg computes the anchors that fall on it; tracks without length have none.
    """
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    nm = geo.haversine_nm(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    d = df.withColumns({"_la": F.lag("latitude").over(w), "_lo": F.lag("longitude").over(w), "_d": F.coalesce(nm, F.lit(0.0))})
    d = d.withColumns({"_s": F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0)), "_total": F.sum("_d").over(W.partitionBy("track_id"))}).where("_total > 0")
    n = anchors - 1
    share = lambda x: F.floor(x / F.col("_total") * n + 1e-9)
    first = F.when(F.col("_la").isNull(), F.lit(0)).otherwise(share(F.col("_s") - F.col("_d")) + 1)
    last = F.when(F.col("_la").isNull(), F.lit(0)).otherwise(F.least(F.lit(n), share(F.col("_s"))))
    d = d.withColumns({"_i": first, "_j": last}).where("_j >= _i").withColumn("anchor", F.explode(F.sequence("_i", "_j")))
    f = F.when(F.col("_d") > 0, (F.col("anchor") / n * F.col("_total") - (F.col("_s") - F.col("_d"))) / F.col("_d")).otherwise(1.0)
    at = lambda c, p: F.when(F.col(p).isNull(), F.col(c)).otherwise(F.col(p) + f * (F.col(c) - F.col(p))).alias(c)
    return d.select("track_id", "anchor", at("latitude", "_la"), at("longitude", "_lo"))


def corridor(points: DataFrame, key: str, least: int = 5, least_width_m: float = 100.0) -> DataFrame:
    """(key, anchor, latitude, longitude, width_m, tracks): medians over tracks, and the 90th percentile of distances to them."""
    mid = points.groupBy(key, "anchor").agg(F.percentile("latitude", 0.5).alias("_y"), F.percentile("longitude", 0.5).alias("_x"), F.count("*").alias("tracks")).where(F.col("tracks") >= least)
    far = points.join(mid, [key, "anchor"]).withColumn("_m", geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("_y"), F.col("_x")))
    return far.groupBy(key, "anchor").agg(F.first("_y").alias("latitude"), F.first("_x").alias("longitude"), F.greatest(F.percentile("_m", 0.9), F.lit(least_width_m)).alias("width_m"), F.first("tracks").alias("tracks"))
