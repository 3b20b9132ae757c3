"""Context learned from history: traffic cells, stop cells, reporting habits, familiarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.operators.ranges import running_sum


def densify(df: DataFrame, step_nm: float = 1.0, max_dt_s: float = 1800.0, max_kn: float = 50.0, most: int = 400) -> DataFrame:
    """Points (track_id, t, latitude, longitude, sog) about step_nm apart on plausible legs; other legs give their starts alone."""
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    nxt = {f"_{c}": F.lead(c).over(w) for c in ("t", "latitude", "longitude", "sog")}
    df = df.withColumns(nxt)
    nm, dt = geo.haversine_nm(F.col("latitude"), F.col("longitude"), F.col("_latitude"), F.col("_longitude")), F.col("_t") - F.col("t")
    ok = (dt <= max_dt_s) & (nm / F.greatest(dt, F.lit(1.0)) * 3600 <= max_kn)
    n = F.when(ok, F.least(F.greatest(F.ceil(nm / step_nm), F.lit(1)), F.lit(most))).otherwise(1)
    df = df.withColumn("_n", n.cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = F.col("_k") / F.col("_n")
    at = lambda c: F.when(F.col("_t").isNull(), F.col(c)).otherwise(F.col(c) + f * (F.col(f"_{c}") - F.col(c))).alias(c)
    sog = F.when(F.col("_t").isNull(), F.col("sog")).otherwise((F.col("sog") + F.col("_sog")) / 2).alias("sog")
    return df.select("track_id", "event_id", at("t"), at("latitude"), at("longitude"), sog)


def traffic_cells(points: DataFrame, size: float = 0.5, min_kn: float = 3.0) -> DataFrame:
    """(ci, cj, vessels): distinct moving vessels per cell."""
    moving = points.where(F.coalesce("sog", F.lit(0.0)) >= min_kn)
    return moving.groupBy(geo.cell(F.col("latitude"), size).alias("ci"), geo.cell(F.col("longitude"), size).alias("cj")).agg(F.count_distinct("track_id").alias("vessels"))


def familiarity(cells: DataFrame) -> DataFrame:
    """(ci, cj, familiarity): the sum of the 3 x 3 neighbours' counts over four, for every cell near traffic.

    Counts are spread to their neighbours once, so a look-up is one equi-join.
    """
    near = F.array(*[F.struct((F.col("ci") + a).alias("ci"), (F.col("cj") + b).alias("cj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return cells.select("vessels", F.inline(near)).groupBy("ci", "cj").agg((F.sum("vessels") / 4.0).alias("familiarity"))


def stop_cells(df: DataFrame, size: float = 0.5, slow_kn: float = 3.0, min_slow_s: float = 3600.0, max_dt_s: float = 86_400.0) -> DataFrame:
    """(ci, cj, vessels): vessels that were slow in a cell for at least min_slow_s in all."""
    dt = F.lead("t").over(W.partitionBy("track_id").orderBy("t", "event_id")) - F.col("t")
    slow = df.withColumn("dt", dt).where((F.coalesce("sog", F.lit(0.0)) < slow_kn) & (F.col("dt") > 0) & (F.col("dt") <= max_dt_s))
    per = slow.groupBy(geo.cell(F.col("latitude"), size).alias("ci"), geo.cell(F.col("longitude"), size).alias("cj"), "track_id").agg(F.sum("dt").alias("s"))
    return per.where(F.col("s") >= min_slow_s).groupBy("ci", "cj").agg(F.count("*").alias("vessels"))


def expected_interval(df: DataFrame, size: float = 0.5, least: int = 5) -> DataFrame:
    """(ci, cj, interval): the median interval of reports in a cell, of cells with enough of them."""
    dt = F.lead("t").over(W.partitionBy("track_id").orderBy("t", "event_id")) - F.col("t")
    g = df.withColumn("dt", dt).where("dt > 0").groupBy(geo.cell(F.col("latitude"), size).alias("ci"), geo.cell(F.col("longitude"), size).alias("cj"))
    return g.agg(F.count("*").alias("n"), F.percentile("dt", 0.5).alias("interval")).where(F.col("n") >= least).drop("n")


def gap_habits(df: DataFrame, least: int = 15) -> DataFrame:
    """(track_id, gap_p95) of vessels with enough positive gaps."""
    dt = F.col("t") - F.lag("t").over(W.partitionBy("track_id").orderBy("t", "event_id"))
    g = df.withColumn("dt", dt).where("dt > 0").groupBy("track_id").agg(F.count("*").alias("n"), F.percentile("dt", 0.95).alias("gap_p95"))
    return g.where(F.col("n") >= least).drop("n")


def peer_percentile(gaps: DataFrame, least: int = 500) -> DataFrame:
    """gaps (vessel_type, gap, ...) with the share of its type's gaps that are strictly smaller; null below ``least`` peers."""
    counts = gaps.groupBy("vessel_type", "gap").agg(F.count("*").alias("_m"))
    below = running_sum(counts, ["vessel_type"], [F.col("gap").asc()], "_m", "_below").drop("_m")
    peers = counts.groupBy("vessel_type").agg(F.sum("_m").alias("_n"))
    found = below.join(peers, "vessel_type").select("vessel_type", "gap", F.when(F.col("_n") >= least, F.col("_below") / F.col("_n")).alias("peer"))
    return gaps.join(found, ["vessel_type", "gap"], "left").select(*gaps.columns, "peer")
