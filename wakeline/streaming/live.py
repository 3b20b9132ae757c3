"""Live views by Structured Streaming: deduplication, latest report, rolling trajectory; and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

#: What makes two reports the same fix, whenever they were received.
FINGERPRINT = ("track_id", "base_date_time", "longitude", "latitude", "sog", "cog", "heading", "status")


def deduplicate(stream: DataFrame, delay: str = "24 hours") -> DataFrame:
    """One of each fix within the watermark; works on streams and, without a watermark, on tables."""
    if stream.isStreaming:
        return stream.withWatermark("base_date_time", delay).dropDuplicatesWithinWatermark(list(FINGERPRINT))
    return stream.dropDuplicates(list(FINGERPRINT))


def latest_batch(df: DataFrame) -> DataFrame:
    """Batch twin of latest: the newest report of each vessel; of equal times the one that arrived last."""
    w = W.partitionBy("track_id").orderBy(F.desc("base_date_time"), F.desc("event_id"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


ROLLING = "track_id string, base_date_time timestamp, event_id long, longitude double, latitude double, n_points int, path_lon array<double>, path_lat array<double>"
_STATE = "at timestamp, event_id long, times array<timestamp>, lons array<double>, lats array<double>"


def rolling(stream: DataFrame, minutes: float = 30.0, most: int = 720, moved: float = 1e-5, stale: float = 15.0) -> DataFrame:
    """The latest report of each vessel and its trajectory of the last ``minutes``, updated as reports arrive.

    A report strictly older than the vessel's own latest is ignored (not by a global watermark); an equal time replaces.  A point joins
    the trajectory only if it moved; at most ``most`` are kept.  A vessel without a report for ``stale`` minutes of processing time leaves the
    state.  State per vessel is bounded by ``most``.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, last, times, lons, lats = state.get if state.exists else (None, None, [], [], [])
        times, lons, lats = list(times), list(lons), list(lats)
        rows = pd.concat(list(frames)).sort_values(["event_id"])
        for r in rows.itertuples(index=False):
            t = pd.Timestamp(r.base_date_time)
            if at is not None and t < pd.Timestamp(at):
                continue
            if at is not None and t == pd.Timestamp(at) and times:
                times[-1], lons[-1], lats[-1] = t, r.longitude, r.latitude
            elif not lons or abs(lons[-1] - r.longitude) > moved or abs(lats[-1] - r.latitude) > moved:
                times.append(t)
                lons.append(r.longitude)
                lats.append(r.latitude)
            at, last = t, int(r.event_id)
            keep = next((i for i, x in enumerate(times) if (t - pd.Timestamp(x)).total_seconds() <= minutes * 60), len(times) - 1)
            keep = max(keep, len(times) - most)
            times, lons, lats = times[keep:], lons[keep:], lats[keep:]
        state.update((pd.Timestamp(at).to_pydatetime(), last, [pd.Timestamp(x).to_pydatetime() for x in times], lons, lats))
        state.setTimeoutDuration(int(stale * 60_000))
        yield pd.DataFrame({"track_id": [key[0]], "base_date_time": [at], "event_id": [last], "longitude": [lons[-1]], "latitude": [lats[-1]], "n_points": [len(lons)], "path_lon": [lons], "path_lat": [lats]})

    return stream.groupBy("track_id").applyInPandasWithState(update, ROLLING, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def snapshot(df: DataFrame, as_of: str, stale_s: float = 10_800.0) -> DataFrame:
    """Positions at a time: each vessel's last report up to it, unless that is older than stale_s."""
    t = F.lit(as_of).cast("timestamp")
    seen = latest_batch(df.where(F.col("base_date_time") <= t))
    age = F.unix_micros(t) / 1e6 - F.unix_micros("base_date_time") / 1e6
    return seen.withColumn("age_s", age).where(F.col("age_s") <= stale_s)
