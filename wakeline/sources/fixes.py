"""The driver's tables as position reports, zones and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts) -> F.Column:
    """A timestamp as seconds since 1970, with its fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position reports: one row per event."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        e,
        F.concat(F.lit("v"), F.lpad(u.cast("string"), 6, "0")).alias("track_id"),
        u,
        F.col("ts").cast("timestamp").alias("base_date_time"),
        seconds(F.col("ts")).alias("t"),
        (F.lit(118.5) + (u % 10) * 0.45 + ((e * 7919) % 1000) * 0.0004).alias("longitude"),
        (F.lit(21.8) + (u % 9) * 0.5 + ((e * 104729) % 1000) * 0.0004).alias("latitude"),
        F.when(kind == "error", None).otherwise((e * 31 % 200) / 10.0).alias("sog"),
        F.when(kind == "signup", None).otherwise((e * 53 % 360) * 1.0).alias("cog"),
        F.when(kind == "view", None).otherwise((e * 59 % 360) * 1.0).alias("heading"),
        (60 + u % 30).alias("vessel_type"),
        (e % 9).alias("status"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 squares with a kind, and their ring of corners."""
    k = F.col("n_nationkey")
    lon, lat, h = F.lit(118.7) + (k % 5) * 0.9, F.lit(22.0) + F.floor(k / 5) * 0.9, F.lit(0.15)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("protected", "cable", "restricted", "port", "fishing_ground")]), F.least(F.col("n_regionkey"), F.lit(4)).cast("int") + 1)
    out = table(spark, sf_dir, "nation").select(k.alias("zone_id"), F.col("n_name").alias("name"), kind.alias("kind"), lon.alias("lon_c"), lat.alias("lat_c"), h.alias("half_deg"))
    corner = lambda a, b: F.struct((F.col("lat_c") + a * F.col("half_deg")).alias("lat"), (F.col("lon_c") + b * F.col("half_deg")).alias("lon"))
    return out.withColumn("ring", F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1)))
