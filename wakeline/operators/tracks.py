"""Tracks: cleaning, gap sessions, sliding windows and movement features.

All per-track work is on one partitioning by track_id (sessions) and one by segment and window (features).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.operators.ranges import percentile_of, percentiles
from wakeline.scratch import Scratch


@dataclass(frozen=True)
class TrackConfig:
    """Settings of sessions, windows and features."""

    segment_gap_s: float = 600.0
    window_s: float = 1800.0
    stride_s: float = 300.0
    min_observations: int = 10
    min_span_s: float = 1200.0
    min_valid_fraction: float = 0.8
    low_speed_kn: float = 3.0
    course_min_kn: float = 1.0
    min_displacement_m: float = 50.0


def clean_kinematics(df: DataFrame) -> DataFrame:
    """Speed, course and heading out of range become null (sog >= 0, 0 <= cog < 360, 0 <= heading <= 359)."""
    return df.withColumns({"sog": F.when(F.col("sog") >= 0, F.col("sog")), "cog": F.when((F.col("cog") >= 0) & (F.col("cog") < 360), F.col("cog")), "heading": F.when(F.col("heading").between(0, 359), F.col("heading"))})


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of rows that agree in all columns; repeated timestamps with other values stay."""
    return df.dropDuplicates()


def _by_track() -> W:
    return W.partitionBy("track_id").orderBy("t", "event_id")


def with_gaps(df: DataFrame) -> DataFrame:
    """Adds gap: seconds since the track's report before."""
    return df.withColumn("gap", F.col("t") - F.lag("t").over(_by_track()))


def segments(df: DataFrame, cfg: TrackConfig) -> DataFrame:
    """Adds segment_ordinal and segment_id: a gap strictly above the limit starts a new segment."""
    running = _by_track().rowsBetween(W.unboundedPreceding, 0)
    df = with_gaps(df).withColumn("segment_ordinal", F.sum((F.coalesce(F.col("gap"), F.lit(0.0)) > cfg.segment_gap_s).cast("int")).over(running) + 1)
    return df.withColumn("segment_id", F.format_string("%s:s%04d", "track_id", "segment_ordinal")).withColumn("segment_gap", F.when(F.lag("segment_ordinal").over(_by_track()) == F.col("segment_ordinal"), F.col("gap")))


def segment_summary(df: DataFrame) -> DataFrame:
    """One row per segment: bounds, gaps, valid counts, type and quality."""
    gap = F.col("segment_gap")
    out = df.groupBy("track_id", "segment_id", "segment_ordinal").agg(
        F.count("*").alias("n"),
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        F.percentile(gap, 0.5).alias("median_gap"),
        F.max(gap).alias("max_gap"),
        F.count("sog").alias("n_sog"),
        F.count("cog").alias("n_cog"),
        F.count("heading").alias("n_heading"),
        F.when(F.count_distinct("vessel_type") == 1, F.min("vessel_type")).alias("vessel_type"),
    )
    return out.withColumns({"duration_s": F.col("t1") - F.col("t0"), "sog_fraction": F.col("n_sog") / F.col("n")}).withColumn("quality", F.when(F.col("n") < 2, "single_report").when(F.col("duration_s") <= 0, "no_duration").otherwise("ok"))


def windows(df: DataFrame, cfg: TrackConfig) -> DataFrame:
    """Reports of segments, once for each full window [start, start + window) of their segment that holds them.

    Windows are anchored at the segment's start; each report computes the few ordinals that cover it, so there is no join.
    """
    seg = W.partitionBy("segment_id")
    t0, t1 = F.min("t").over(seg), F.max("t").over(seg)
    df = _pairs(df, cfg).withColumns({"t0": t0, "n_windows": F.floor((t1 - t0 - cfg.window_s) / cfg.stride_s) + 1})
    since = F.col("t") - F.col("t0")
    first = F.greatest(F.lit(0), F.floor((since - cfg.window_s) / cfg.stride_s) + 1)
    last = F.least(F.col("n_windows") - 1, F.floor(since / cfg.stride_s))
    df = df.withColumns({"_a": first.cast("long"), "_b": last.cast("long")}).where("_b >= _a")
    df = df.withColumn("window_ordinal", F.explode(F.sequence("_a", "_b"))).withColumn("window_start", F.col("t0") + F.col("window_ordinal") * cfg.stride_s).drop("_a", "_b")
    inside = F.col("_t") >= F.col("window_start")  # else the report before isn't in the window
    return df.withColumns({c: F.when(inside, F.col(c)) for c in ("_t", "_sog", "_course", "_turn", "_leg", "_dt")})


def _pairs(df: DataFrame, cfg: TrackConfig) -> DataFrame:
    """Adds what a report makes with the one before it in its segment: once, before reports are copied to their windows."""
    w = W.partitionBy("segment_id").orderBy("t", "event_id")
    before = {f"_{c}": F.lag(c).over(w) for c in ("t", "sog", "cog", "latitude", "longitude")}
    paired = df.withColumns(before).withColumns(
        {
            "_course": (F.col("sog") >= cfg.course_min_kn) & (F.col("_sog") >= cfg.course_min_kn) & F.col("cog").isNotNull() & F.col("_cog").isNotNull(),
            "_turn": F.abs(geo.circular_difference(F.col("_cog"), F.col("cog"))),
            "_leg": geo.haversine_m(F.col("_latitude"), F.col("_longitude"), F.col("latitude"), F.col("longitude")),
            "_dt": F.col("t") - F.col("_t"),
        }
    )
    return paired.drop("_cog", "_latitude", "_longitude")


def window_table(df: DataFrame, cfg: TrackConfig) -> DataFrame:
    """Metadata, quality label and the ten movement features of each window (input: windows()).

    Reports are counted before the span is judged.  Fractions are of all reports of the window.  A feature is null
    unless the window is sufficient and enough of what it needs is there.  Percentiles are those of the SQL to the last bit, as
    thresholds stand at values that they take.
    """
    eligible = F.coalesce(F.col("_course"), F.lit(False))
    low = (F.col("sog") < cfg.low_speed_kn) & (F.col("_sog") < cfg.low_speed_kn) & (F.col("_dt") > 0)
    drift = F.abs(geo.circular_difference(F.col("cog"), F.col("heading")))
    where = F.struct("t", "event_id", "latitude", "longitude")
    g = df.groupBy("track_id", "segment_id", "window_ordinal").agg(
        F.min("window_start").alias("window_start"),
        F.count("*").alias("n"),
        (F.max("t") - F.min("t")).alias("span_s"),
        F.count("sog").alias("n_sog"),
        F.count("cog").alias("n_cog"),
        F.count_if(F.col("cog").isNotNull() & F.col("heading").isNotNull()).alias("n_pairs"),
        F.count_if(eligible).alias("n_course_pairs"),
        F.sort_array(F.collect_list("sog")).alias("_sogs"),
        F.avg((F.col("sog") < cfg.low_speed_kn).cast("double")).alias("_low_fraction"),
        F.sum(F.when(low, F.col("_dt")).otherwise(0.0)).alias("_low_s"),
        F.sum(F.coalesce("_leg", F.lit(0.0))).alias("_path_m"),
        F.min(where).alias("_first"),
        F.max(where).alias("_last"),
        F.sum(F.when(eligible, F.col("_turn"))).alias("_turn_sum"),
        F.sort_array(F.collect_list(F.when(eligible, F.col("_turn")))).alias("_turns"),
        F.sort_array(F.collect_list(drift)).alias("_drifts"),
    )
    g = percentile_of(g, {"_sog_median": ("_sogs", 0.5), "_sog_p95": ("_sogs", 0.95), "_turn_p95": ("_turns", 0.95), "_drift": ("_drifts", 0.5)})
    g = g.withColumn("quality", F.when(F.col("n") < cfg.min_observations, "too_few_reports").when(F.col("span_s") < cfg.min_span_s, "span_too_short").otherwise("sufficient"))
    ok = F.col("quality") == "sufficient"
    sog = ok & (F.col("n_sog") / F.col("n") >= cfg.min_valid_fraction)
    course = ok & (F.col("n_cog") / F.col("n") >= cfg.min_valid_fraction) & (F.col("n_course_pairs") >= 2)
    paired = ok & (F.col("n_pairs") / F.col("n") >= cfg.min_valid_fraction)
    shift = geo.haversine_m(F.col("_first.latitude"), F.col("_first.longitude"), F.col("_last.latitude"), F.col("_last.longitude"))
    g = g.withColumn("_shift", shift)
    return g.select(
        "track_id",
        "segment_id",
        "window_ordinal",
        "window_start",
        "n",
        "span_s",
        "n_sog",
        "n_cog",
        "n_pairs",
        "n_course_pairs",
        "quality",
        F.when(sog, F.col("_sog_median")).alias("sog_median"),
        F.when(sog, F.col("_sog_p95")).alias("sog_p95"),
        F.when(sog, F.col("_low_fraction")).alias("low_speed_fraction"),
        F.when(sog, F.col("_low_s")).alias("low_speed_s"),
        F.when(ok, F.col("_path_m")).alias("path_m"),
        F.when(ok, F.col("_shift")).alias("displacement_m"),
        F.when(ok & (F.col("_shift") >= cfg.min_displacement_m), F.col("_path_m") / F.col("_shift")).alias("path_ratio"),
        F.when(course, F.col("_turn_sum")).alias("turn_sum"),
        F.when(course, F.col("_turn_p95")).alias("turn_p95"),
        F.when(paired, F.col("_drift")).alias("drift_median"),
    )


FEATURES = ("sog_median", "sog_p95", "low_speed_fraction", "low_speed_s", "path_m", "displacement_m", "path_ratio", "turn_sum", "turn_p95", "drift_median")


def distribution_summary(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Count, missing and quantiles of each column, a row each."""
    long = Scratch(df.sparkSession, "summary").save(df.unpivot([], list(columns), "feature", "value"), "long")  # read three times
    plain = long.groupBy("feature").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return plain.join(percentiles(long, ["feature"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}), "feature", "left")


def gap_statistics(df: DataFrame, threshold_s: float) -> DataFrame:
    """One row: pairs, signs, number above a threshold, and positive gaps' minimum, median and maximum."""
    g, up = F.col("gap"), F.when(F.col("gap") > 0, F.col("gap"))
    gaps = with_gaps(df)
    plain = gaps.agg(F.count(g).alias("pairs"), F.count(up).alias("positive"), F.count_if(g == 0).alias("zero"), F.count_if(g < 0).alias("negative"), F.count_if(g > threshold_s).alias("above"), F.min(up).alias("least"), F.max(up).alias("most"))
    middle = percentiles(gaps.where("gap > 0"), [], "gap", {"median": 0.5})
    return plain.crossJoin(F.broadcast(middle)).select("pairs", "positive", "zero", "negative", "above", "least", "median", "most")  # a row each


def whole_tracks(df: DataFrame, ceiling: int) -> DataFrame:
    """Reports of tracks taken in id order as long as all of a track fits under the ceiling; later, smaller ones still may.

    The fold over track sizes is sequential by definition; its input is one row per track.
    """
    sizes = df.groupBy("track_id").agg(F.count("*").alias("n"))
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("track_id", "n"))),
        F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("kept")),
        lambda s, x: F.when(s["total"] + x["n"] <= ceiling, F.struct((s["total"] + x["n"]).alias("total"), F.concat(s["kept"], F.array(x["track_id"])).alias("kept"))).otherwise(s),
    )
    kept = sizes.agg(fold.alias("s")).select(F.explode("s.kept").alias("track_id"))
    return df.join(kept, "track_id", "left_semi")


def zero_inclusive(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children per parent, 0 for those without any."""
    return parents.select(key).distinct().join(children.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def islands(df: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with a true flag, with the number of their run of consecutive true flags."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("run", F.sum((~F.col("_flag")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_flag").drop("_flag")
