"""Scans that are sequential within a vessel, and geodesics: grouped and vectorised Python over data that Spark deals by vessel."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: WGS84.
A, FLAT = 6_378_137.0, 1 / 298.257223563


def vincenty_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Geodesic distance in metres on WGS84; where the iteration doesn't settle (near antipodes) the great-circle distance."""
    b = A * (1 - FLAT)
    p1, p2, l_ = np.radians(lat1), np.radians(lat2), np.radians((lon2 - lon1 + 180) % 360 - 180)
    u1, u2 = np.arctan((1 - FLAT) * np.tan(p1)), np.arctan((1 - FLAT) * np.tan(p2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, settled = l_.copy(), np.zeros(l_.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / np.where(ss > 0, ss, 1), 0.0)
            ca = 1 - sa**2
            cm = np.where(ca > 1e-15, cs - 2 * s1 * s2 / np.where(ca > 1e-15, ca, 1), 0.0)
            c = FLAT / 16 * ca * (4 + FLAT * (4 - 3 * ca))
            new = l_ + (1 - c) * FLAT * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        k = ca * (A**2 - b**2) / b**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        d = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        out = b * big * (sigma - d)
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(l_ / 2) ** 2
        plain = 2 * 6_371_008.8 * np.arcsin(np.sqrt(np.minimum(1, h)))
    return np.where(settled & np.isfinite(out), out, plain)


def geodesic(df: DataFrame, key: str, cols: tuple[str, str, str, str]) -> DataFrame:
    """(key, metres) of each row's two points; null where a coordinate is missing."""

    def run(batches):
        for b in batches:
            x = [b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(4)]
            m = vincenty_m(*x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(np.isnan(sum(x)), np.nan, m), from_pandas=True)], [key, "metres"])

    return df.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(run, f"{key} long, metres double")


def stay_points(df: DataFrame, radius_nm: float, min_s: float, break_s: float, least: int = 2, max_kn: float | None = None) -> DataFrame:
    """(track_id, t0, t1, n, latitude, longitude): stays found by a greedy scan of each track.

    From each start the longest run of reports is taken that stays in a box of twice the radius and has no gap above break_s; if it
    lasts min_s, has `least` reports and (with max_kn, for which df has sog) no higher median speed, it is a stay and the scan goes on behind
    it, else from the next report.  No stay spans a gap above break_s, so tracks are cut there: a long one is many groups.
    """
    side = 2 * radius_nm / 60

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "event_id"])
        t, la, lo = (g[c].to_numpy() for c in ("t", "latitude", "longitude"))
        kn = g["sog"].to_numpy(dtype=float) if max_kn is not None else None
        out, i, n = [], 0, len(t)
        while i < n - 1:
            j, la0, la1, lo0, lo1 = i, la[i], la[i], lo[i], lo[i]
            k = max(0.2, np.cos(np.radians(la[i])))
            while j + 1 < n and t[j + 1] - t[j] <= break_s:
                a0, a1, b0, b1 = min(la0, la[j + 1]), max(la1, la[j + 1]), min(lo0, lo[j + 1]), max(lo1, lo[j + 1])
                if a1 - a0 > side or (b1 - b0) * k > side:
                    break
                j, la0, la1, lo0, lo1 = j + 1, a0, a1, b0, b1
            lasts = j + 1 - i >= least and t[j] - t[i] >= min_s
            if lasts and max_kn is not None:
                told = kn[i : j + 1][np.isfinite(kn[i : j + 1])]
                lasts = not len(told) or np.median(told) <= max_kn
            if lasts:
                out.append((g["track_id"].iloc[0], t[i], t[j], j - i + 1, la[i : j + 1].mean(), lo[i : j + 1].mean()))
                i = j + 1
            else:
                i += 1
        return pd.DataFrame(out, columns=["track_id", "t0", "t1", "n", "latitude", "longitude"])

    need = df.select("track_id", "event_id", "t", "latitude", "longitude", *(["sog"] if max_kn is not None else [])).where("latitude is not null and longitude is not null")
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    apart = F.coalesce(F.col("t") - F.lag("t").over(w) > break_s, F.lit(False)).cast("int")
    need = need.withColumn("_apart", apart).withColumn("_part", F.sum("_apart").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_apart")
    return need.groupBy("track_id", "_part").applyInPandas(scan, "track_id string, t0 double, t1 double, n long, latitude double, longitude double")
