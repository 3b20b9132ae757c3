"""Behaviour detectors: each turns reports into events (kind, track_id, t0, t1, latitude, longitude, severity, confidence, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.operators import joins as J
from wakeline.operators import tracks as T

#: Declared statuses of a vessel at rest.
STATIC = (1, 5, 6)
#: Weight of an event kind in the risk.
KIND_WEIGHT = {"position_jump": 0.9, "ais_gap": 0.8, "zone_entry": 0.8, "status_mismatch": 0.7, "rendezvous": 0.9, "route_deviation": 0.7}


@dataclass(frozen=True)
class DetectConfig:
    gap_min_s: float = 3600.0
    jump_min_kn: float = 60.0
    jump_min_nm: float = 4.0
    jump_link_s: float = 3600.0
    alternations: int = 4
    static_min_kn: float = 3.0
    static_min_fixes: int = 3
    static_min_s: float = 900.0
    static_min_nm: float = 0.5
    zone_min_dwell_s: float = 0.0
    meet_min_steps: int = 2
    stationary_nm: float = 1.0


def clip(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def _by_track():
    return W.partitionBy("track_id").orderBy("t", "event_id")


def legs(df: DataFrame) -> DataFrame:
    """Each report with the one before: dt, nm and implied kn."""
    w = _by_track()
    df = df.withColumns({f"_{c}": F.lag(c).over(w) for c in ("t", "latitude", "longitude", "sog", "status")})
    df = df.withColumns({"dt": F.col("t") - F.col("_t"), "nm": geo.haversine_nm(F.col("_latitude"), F.col("_longitude"), F.col("latitude"), F.col("longitude"))})
    return df.withColumn("kn", F.when(F.col("dt") > 0, F.col("nm") / F.greatest("dt", F.lit(1.0)) * 3600).otherwise(0.0))


def gaps(df: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Silences of at least gap_min_s, but for vessels at rest before; severity grows with length, speed before, and implausible return."""
    g = legs(df).where((F.col("dt") >= cfg.gap_min_s) & ~F.coalesce(F.col("_status").isin(*STATIC), F.lit(False)))
    underway = F.coalesce("_sog", F.lit(0.0)) >= 4
    over = F.least(F.lit(1.0), (F.col("dt") - cfg.gap_min_s) / (3 * cfg.gap_min_s))
    sev = 35 + 30 * over + F.when(underway, 8).otherwise(0) + F.when(F.col("kn") > cfg.jump_min_kn, 12).otherwise(0)
    sev = F.when(F.col("nm") < cfg.stationary_nm, F.least(sev, F.lit(28.0))).otherwise(sev)
    return g.select("track_id", "event_id", F.lit("ais_gap").alias("kind"), F.col("_t").alias("t0"), F.col("t").alias("t1"), ((F.col("latitude") + F.col("_latitude")) / 2).alias("latitude"), ((F.col("longitude") + F.col("_longitude")) / 2).alias("longitude"), clip(sev).alias("severity"), F.lit(0.55).alias("confidence"), (F.col("nm") < cfg.stationary_nm).alias("stationary"))


def jumps(df: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Implausible legs, those within jump_link_s of the one before in one event; many alternations make an identity conflict."""
    bad = legs(df).where((F.col("kn") >= cfg.jump_min_kn) & (F.col("nm") >= cfg.jump_min_nm))
    w = W.partitionBy("track_id").orderBy("_t", "event_id")
    apart = F.coalesce(F.col("_t") - F.lag("_t").over(w) > cfg.jump_link_s, F.lit(True)).cast("int")
    bad = bad.withColumn("_k", apart).withColumn("run", F.sum("_k").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = bad.groupBy("track_id", "run").agg(F.count("*").alias("n"), F.min("_t").alias("t0"), F.max("t").alias("t1"), F.max("nm").alias("jump_nm"), F.max("kn").alias("peak_kn"), F.min_by("_latitude", F.struct("_t", "event_id")).alias("latitude"), F.min_by("_longitude", F.struct("_t", "event_id")).alias("longitude"))
    many = F.col("n") >= cfg.alternations
    jump = 60 + 20 * F.least(F.lit(1.0), F.col("peak_kn") / (4 * cfg.jump_min_kn)) + F.when(F.col("n") >= 2, 8).otherwise(0)
    return g.select("track_id", F.when(many, "identity_conflict").otherwise("position_jump").alias("kind"), "t0", "t1", "latitude", "longitude", "n", "jump_nm", clip(F.when(many, 78 + 12 * F.least(F.lit(1.0), F.col("n") / 20)).otherwise(jump)).alias("severity"), F.when(many, 0.85).otherwise(0.8).alias("confidence"))


def status_mismatch(df: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Runs of reports that declare rest while moving."""
    flag = F.col("status").isin(*STATIC) & (F.coalesce("sog", F.lit(0.0)) >= cfg.static_min_kn)
    runs = T.islands(df, flag, ["track_id"], ["t", "event_id"])
    order, place = F.struct("t", "event_id"), F.struct("latitude", "longitude")
    g = runs.groupBy("track_id", "run").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.percentile("sog", 0.5).alias("kn"), F.min_by(place, order).alias("a"), F.max_by(place, order).alias("b"))
    g = g.withColumn("nm", geo.haversine_nm(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude")))
    g = g.where((F.col("n") >= cfg.static_min_fixes) & (F.col("t1") - F.col("t0") >= cfg.static_min_s) & (F.col("nm") >= cfg.static_min_nm))
    sev = 48 + 20 * F.least(F.lit(1.0), (F.col("t1") - F.col("t0")) / 3600) + 8 * F.least(F.lit(1.0), F.col("kn") / 12)
    return g.select("track_id", F.lit("status_mismatch").alias("kind"), "t0", "t1", F.col("a.latitude").alias("latitude"), F.col("a.longitude").alias("longitude"), "n", clip(sev).alias("severity"), F.lit(0.75).alias("confidence"))


def zone_entries(df: DataFrame, zones: DataFrame, cfg: DetectConfig, base: dict[str, float]) -> DataFrame:
    """Stays in sensitive zones: runs of consecutive reports inside, with severity by kind, dwell and slow speed.

    A run breaks where a report of the vessel lies outside: positions in the whole track against positions among those inside.
    """
    numbered = df.withColumn("_i", F.row_number().over(_by_track()))
    inside = J.in_squares(numbered, zones.where(F.col("kind").isin(*base)))
    w = W.partitionBy("track_id", "zone_id").orderBy("_i")
    inside = inside.withColumn("run", F.col("_i") - F.row_number().over(w))
    g = inside.groupBy("track_id", "zone_id", "kind", "run").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("sog").alias("least_kn"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    dwell = F.col("t1") - F.col("t0")
    slow = (F.coalesce("least_kn", F.lit(0.0)) < 3) & (dwell > 600)
    kind = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in base.items()])
    sev = kind + 8 * F.least(F.lit(1.0), dwell / 3600) + F.when(slow, 15).when(dwell <= 600, -18).otherwise(0)
    return g.where(dwell >= cfg.zone_min_dwell_s).select("track_id", "zone_id", F.lit("zone_entry").alias("kind"), F.col("kind").alias("zone_kind"), "t0", "t1", "latitude", "longitude", "n", clip(sev).alias("severity"), F.lit(0.8).alias("confidence"))


def risk(events: DataFrame, keys: list[str]) -> DataFrame:
    """Noisy-or of the best event of each kind: 100 (1 - prod(1 - 0.9 min(p, 1))), p = weight severity (0.6 + 0.4 confidence) / 100."""
    weight = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in KIND_WEIGHT.items()], F.lit(0.8))
    p = weight * F.col("severity") * (0.6 + 0.4 * F.col("confidence")) / 100
    best = events.withColumn("p", p).groupBy(*keys, "kind").agg(F.max("p").alias("p"))
    out = best.groupBy(*keys).agg(F.sort_array(F.collect_set("kind")).alias("kinds"), (100 * (1 - F.exp(F.sum(F.log1p(-0.9 * F.least("p", F.lit(1.0))))))).alias("risk"))
    return out.withColumn("level", F.when(F.col("risk") >= 75, "HIGH").when(F.col("risk") >= 50, "MEDIUM").otherwise("LOW"))


def link_groups(events: DataFrame, window_s: float) -> DataFrame:
    """Events of a vessel in groups: one is linked to the one before (by start) if it starts within window_s of that one's end."""
    w = W.partitionBy("track_id").orderBy("t0", "t1", "kind")
    apart = F.coalesce(F.col("t0") - F.lag("t1").over(w) > window_s, F.lit(True)).cast("int")
    return events.withColumn("_k", apart).withColumn("alert", F.sum("_k").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_k")
