"""Survey-like movement: long legs turned back on each other, found in overlapping windows of a track and merged to stretches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.operators import joins as J


@dataclass(frozen=True)
class SurveyConfig:
    """Settings of survey patterns; angles in degrees, distances in nautical miles."""

    gap_s: float = 86_400.0
    window_s: float = 86_400.0
    min_reports: int = 10
    min_legs: int = 4
    min_leg_nm: float = 3.0
    turn_deg: float = 60.0
    back_deg: float = 105.0
    parallel_deg: float = 35.0
    length_spread: float = 0.6
    side_step: float = 0.08
    max_kn: float = 9.0
    benign_share: float = 0.4
    check_reported: bool = False

    @property
    def min_move_nm(self) -> float:
        return max(2.0, 0.2 * self.min_leg_nm)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between directions given as complex numbers, in degrees."""
    return np.abs(np.degrees(np.angle(a * np.conj(b))))


def long_legs(z: np.ndarray, cfg: SurveyConfig) -> list[tuple[int, int, complex]]:
    """(first, last, direction) of the straight runs of a path of complex positions that are long enough.

    Moves below min_move_nm from the last point kept are jitter.  A leg ends where the next move turns away from its moves' sum.
    """
    kept = [0]
    for i, p in enumerate(z):
        if abs(p - z[kept[-1]]) >= cfg.min_move_nm:
            kept.append(i)
    if len(kept) < 3:
        return []
    legs, total, begun = [], 0j, kept[0]
    for a, b in zip(kept[:-1], kept[1:], strict=True):
        move = z[b] - z[a]
        if total and _angle(move, total) > cfg.turn_deg:
            legs.append((begun, a, total))
            total, begun = 0j, a
        total += move
    legs.append((begun, kept[-1], total))
    return [(a, b, d / abs(d) if d else 0j) for a, b, d in legs if abs(z[b] - z[a]) >= cfg.min_leg_nm]


def _turned_back(legs: list[tuple[int, int, complex]], cfg: SurveyConfig) -> list[tuple[int, int, complex]]:
    """The longest run of legs that each turn back on the one before; the first of equally long ones."""
    best: list = []
    run: list = []
    for leg in legs:
        run = [*run, leg] if run and _angle(leg[2], run[-1][2]) >= cfg.back_deg else [leg]
        best = run if len(run) > len(best) else best
    return best


def pattern(t: np.ndarray, z: np.ndarray, sog: np.ndarray, benign: np.ndarray, cfg: SurveyConfig) -> dict | None:
    """The survey pattern of one window's reports, if there is one: its first and last report and what describes it."""
    legs = long_legs(z, cfg)
    if not legs:
        return None
    size = lambda leg: abs(z[leg[1]] - z[leg[0]])
    axis = max(legs, key=size)[2]
    aside = [_angle(d, axis) for _, _, d in legs]
    along = [leg for leg, a in zip(legs, aside, strict=True) if min(a, 180 - a) <= cfg.parallel_deg]
    chosen = max((_turned_back(legs, cfg), _turned_back(along, cfg)), key=len)  # every leg, or those along the longest
    if len(chosen) < cfg.min_legs:
        return None
    lengths = np.array([size(leg) for leg in chosen])
    middles = np.array([(z[a] + z[b]) / 2 for a, b, _ in chosen])
    steps = np.abs((np.diff(middles) * np.conj([d for _, _, d in chosen[:-1]])).imag)
    a, b = chosen[0][0], chosen[-1][1]
    path, hours = float(np.abs(np.diff(z[a : b + 1])).sum()), (t[b] - t[a]) / 3600
    if lengths.std() > cfg.length_spread * max(lengths.mean(), 1e-6) or steps.mean() < cfg.side_step * lengths.mean() or hours <= 0 or path / hours > cfg.max_kn:
        return None
    told = sog[a : b + 1][np.isfinite(sog[a : b + 1])]
    if cfg.check_reported and len(told) >= 6 and path / hours > 2 and np.median(told) < 0.35 * path / hours:
        return None  # positions that jump, not legs that were sailed
    if benign[[leg[0] for leg in chosen]].mean() > cfg.benign_share:
        return None  # it turns where vessels stop anyway
    box = z[a : b + 1]
    return {"a": a, "b": b, "legs": len(chosen), "mean_leg_nm": float(lengths.mean()), "spacing_nm": float(steps.mean()), "area_nm2": float(np.ptp(box.real) * np.ptp(box.imag)), "hours": float(hours), "path_nm": path}


DESCRIBED = ("legs", "mean_leg_nm", "spacing_nm", "area_nm2", "hours", "path_nm")


def survey_windows(df: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """(track_id, session, k, a, b, ...): the pattern of each window that has one; a and b number reports within their track's session.

    Sessions end at gaps; windows of window_s start every half of it from a session's start.  A report finds the windows it lies in by
    arithmetic, and each window is a group, so a vessel with most of all reports is many groups.
    """
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    apart = F.coalesce(F.col("t") - F.lag("t").over(w) > cfg.gap_s, F.lit(False)).cast("int")
    df = df.where("latitude is not null and longitude is not null").withColumn("_apart", apart)
    df = df.withColumn("session", F.sum("_apart").over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = W.partitionBy("track_id", "session")
    df = df.withColumns({"i": F.row_number().over(s.orderBy("t", "event_id")), "_t0": F.min("t").over(s), "_t1": F.max("t").over(s), "_lat0": F.avg("latitude").over(s), "_lon0": F.avg("longitude").over(s)})
    hop = cfg.window_s / 2
    since = F.col("t") - F.col("_t0")
    first = F.greatest(F.lit(0), F.floor((since - cfg.window_s) / hop) + 1).cast("long")
    last = F.least(F.floor(since / hop), F.ceil((F.col("_t1") - F.col("_t0") - hop) / hop) - 1).cast("long")
    df = df.withColumns({"_a": first, "_b": last}).where("_b >= _a").withColumn("k", F.explode(F.sequence("_a", "_b")))
    x = F.radians(F.col("longitude") - F.col("_lon0")) * F.cos(F.radians("_lat0")) * (geo.EARTH_M / geo.NM_M)
    y = F.radians(F.col("latitude") - F.col("_lat0")) * (geo.EARTH_M / geo.NM_M)
    need = df.select("track_id", "session", "k", "i", "t", x.alias("x"), y.alias("y"), F.col("sog").cast("double").alias("sog"), F.coalesce("benign", F.lit(False)).alias("benign"))

    def found(keys, g):
        g = g.sort_by("i")
        one = None
        if g.num_rows >= cfg.min_reports:
            col = lambda c: g[c].to_numpy()
            one = pattern(col("t"), col("x") + 1j * col("y"), col("sog").astype(float), col("benign"), cfg)
        row = dict(zip(("track_id", "session", "k"), (k.as_py() for k in keys), strict=True))
        rows = []
        if one:
            number = g["i"].to_numpy()
            rows = [row | one | {"a": int(number[one["a"]]), "b": int(number[one["b"]])}]
        return pa.Table.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = "track_id string, session long, k long, a long, b long, legs long, mean_leg_nm double, spacing_nm double, area_nm2 double, hours double, path_nm double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return need.groupBy("track_id", "session", "k").applyInArrow(found, schema)


def merged(found: DataFrame, keys: list[str], a: str, b: str, described: tuple[str, ...], most: str) -> DataFrame:
    """Union of overlapping spans [a, b] of the same keys, each with the description of the span that has most of `most` (first of equals)."""
    w = W.partitionBy(*keys).orderBy(a, b)
    before = F.max(b).over(w.rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("_new", F.coalesce(F.col(a) > before, F.lit(True)).cast("int"))
    found = found.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    best = F.max_by(F.struct(*described), F.struct(F.col(most), -F.col(a), -F.col(b)))
    return found.groupBy(*keys, "_run").agg(F.min(a).alias(a), F.max(b).alias(b), best.alias("_best")).select(*keys, a, b, *[F.col(f"_best.{c}").alias(c) for c in described])


def survey_stretches(df: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """(track_id, session, a, b, legs, mean_leg_nm, spacing_nm, area_nm2, hours, path_nm): what survey_windows finds, merged."""
    return merged(survey_windows(df, cfg), ["track_id", "session"], "a", "b", DESCRIBED, "legs")


def survey_events(df: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """Stretches as events: (track_id, kind, t0, t1, latitude, longitude, severity, confidence, and what describes them)."""
    stretches = survey_stretches(df, cfg).withColumnRenamed("session", "_session").withColumnRenamed("track_id", "_track")
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    apart = F.coalesce(F.col("t") - F.lag("t").over(w) > cfg.gap_s, F.lit(False)).cast("int")
    rows = df.where("latitude is not null and longitude is not null").withColumn("_apart", apart)
    rows = rows.withColumn("session", F.sum("_apart").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("i", F.row_number().over(W.partitionBy("track_id", "session").orderBy("t", "event_id")).cast("long"))
    inside = J.range_bucket_join(rows.select(F.col("track_id").alias("_v"), F.col("session").alias("_s"), "i", "t", "latitude", "longitude", "vessel_type"), stretches.withColumnsRenamed({"_track": "_v", "_session": "_s"}), ["_v", "_s"], "i", "a", "b", 64)
    g = inside.groupBy("_v", "_s", "a", "b", *DESCRIBED).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.min("vessel_type").alias("vessel_type"))
    severity = F.lit(78) + 4 * F.least(F.col("legs") - cfg.min_legs, F.lit(5))
    return g.select(F.col("_v").alias("track_id"), F.lit("survey_pattern").alias("kind"), "t0", "t1", "latitude", "longitude", severity.cast("double").alias("severity"), F.lit(0.8).alias("confidence"), "vessel_type", *DESCRIBED)
