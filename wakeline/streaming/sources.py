"""Which source feeds a site, what it shows, and a bounded live buffer that is analysed batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

CLOUD, EDGE, NONE = "cloud", "edge", "none"


@dataclass(frozen=True)
class FailoverConfig:
    """Seconds after which a source without heartbeat is stale, and for which a returning cloud must hold before it takes over from the edge."""

    cloud_stale_s: float = 90.0
    edge_stale_s: float = 60.0
    hold_s: float = 60.0


def _seen(heartbeats: DataFrame, cfg: FailoverConfig) -> DataFrame:
    """(site_id, t, cloud, edge): whether each source is fresh, at each time at which anything may change."""
    hb = heartbeats.select("site_id", F.col("t").cast("double").alias("t"), "source").where(F.col("site_id").isNotNull() & F.col("t").isNotNull() & F.col("source").isin(CLOUD, EDGE))
    stale = F.when(F.col("source") == CLOUD, cfg.cloud_stale_s).otherwise(cfg.edge_stale_s)
    times = F.array(F.col("t"), F.col("t") + stale + 1, F.when(F.col("source") == CLOUD, F.col("t") + cfg.hold_s))
    points = hb.select("site_id", F.explode(times).alias("t"), F.lit(None).cast("string").alias("source")).where("t is not null").distinct()
    w = W.partitionBy("site_id").orderBy("t", F.col("source").isNull())
    last = lambda s: F.last(F.when(F.col("source") == s, F.col("t")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    both = hb.union(points).withColumns({"_c": last(CLOUD), "_e": last(EDGE)}).where("source is null")
    fresh = lambda at, most: F.coalesce(F.col("t") - F.col(at) <= most, F.lit(False))
    return both.select("site_id", "t", fresh("_c", cfg.cloud_stale_s).alias("cloud"), fresh("_e", cfg.edge_stale_s).alias("edge"))


def failover(heartbeats: DataFrame, cfg: FailoverConfig) -> DataFrame:
    """(site_id, t, mode): when each site's source changes, from heartbeats (site_id, t, source); batch twin of failover_stream.

    A fresh cloud feeds a site, else a fresh edge, else none.  A cloud that comes back while the edge feeds the site takes over when it has been
    fresh for hold_s, or when the edge goes stale.  A run of fresh cloud holds back from its start, so running minima over it tell the mode.
    """
    at = W.partitionBy("site_id").orderBy("t")
    df = _seen(heartbeats, cfg).withColumn("_new", (F.col("cloud") != F.lag("cloud", 1, False).over(at)).cast("int"))
    df = df.withColumns({"_run": F.sum("_new").over(at.rowsBetween(W.unboundedPreceding, 0)), "_was_edge": F.lag("edge", 1, False).over(at)})
    run = W.partitionBy("site_id", "_run").orderBy("t")
    from_edge = F.first("_was_edge").over(run.rowsBetween(W.unboundedPreceding, 0))
    steady = F.min("edge").over(run.rowsBetween(W.unboundedPreceding, 0))
    since = F.col("t") - F.first("t").over(run.rowsBetween(W.unboundedPreceding, 0))
    held = from_edge & steady & (since < cfg.hold_s)
    mode = F.when(F.col("cloud") & ~held, CLOUD).when(F.col("edge"), EDGE).otherwise(NONE)
    df = df.withColumn("mode", mode).withColumn("_before", F.lag("mode").over(at))
    return df.where(F.col("_before").isNull() | (F.col("_before") != F.col("mode"))).select("site_id", "t", "mode")


class Site:
    """One site's state machine: heartbeats move it on, and so do the times at which a source goes stale or a hold is over."""

    def __init__(self, cfg: FailoverConfig, cloud: float | None = None, edge: float | None = None, mode: str | None = None, since: float | None = None, done: float | None = None):
        self.cfg, self.last, self.mode, self.since, self.done = cfg, {CLOUD: cloud, EDGE: edge}, mode, since, done
        self.stale = {CLOUD: cfg.cloud_stale_s, EDGE: cfg.edge_stale_s}

    def due(self) -> list[float]:
        """Times, after what has been seen, at which a source goes stale or a hold is over."""
        out = [t + self.stale[s] + 1 for s, t in self.last.items() if t is not None]
        out += [self.since + self.cfg.hold_s] if self.since is not None else []
        return sorted(t for t in out if self.done is None or t > self.done)

    def at(self, t: float) -> list[tuple[float, str]]:
        """The change of mode at a time, if there is one."""
        fresh = {s: x is not None and t - x <= self.stale[s] for s, x in self.last.items()}
        if fresh[CLOUD] and self.mode == EDGE and fresh[EDGE]:
            self.since = t if self.since is None else self.since
            mode = CLOUD if t - self.since >= self.cfg.hold_s else EDGE
        else:
            mode = CLOUD if fresh[CLOUD] else EDGE if fresh[EDGE] else NONE
        if mode != EDGE or not fresh[CLOUD]:
            self.since = None
        changed = mode != self.mode
        self.mode, self.done = mode, t
        return [(t, mode)] if changed else []

    def until(self, t: float, inclusive: bool) -> list[tuple[float, str]]:
        """Changes at due times before t (and at it), in order."""
        out = []
        while some := [x for x in self.due() if x < t or (inclusive and x <= t)]:
            out += self.at(some[0])
        return out

    def beat(self, t: float, sources: list[str]) -> list[tuple[float, str]]:
        out = self.until(t, False)
        for s in sources:
            self.last[s] = t
        return out + self.at(t)


_SITE = "cloud double, edge double, mode string, since double, done double, times array<double>, sources array<string>"


def failover_stream(heartbeats: DataFrame, cfg: FailoverConfig, delay: str = "30 seconds") -> DataFrame:
    """As failover, for a stream of heartbeats (site_id, at timestamp, source), keyed by site.

    Heartbeats wait in the site's state until the watermark has passed them, so their order of arrival doesn't matter; event-time timers
    make a site move on when nothing arrives.  State is the last heartbeats and those within the delay.  Changes come out in append mode.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cloud, edge, mode, since, done, times, sources = state.get if state.exists else (None, None, None, None, None, [], [])
        site, waiting = Site(cfg, cloud, edge, mode, since, done), list(zip(times, sources, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                known = f[f["source"].isin((CLOUD, EDGE)) & f["at"].notna()]
                waiting += list(zip(known["at"].astype("datetime64[us]").astype("int64") / 1e6, known["source"], strict=True))
        passed = state.getCurrentWatermarkMs() / 1000
        out = []
        for t in sorted({t for t, _ in waiting if t <= passed}):
            out += site.beat(t, [s for x, s in waiting if x == t])
        out += site.until(passed, True)
        waiting = [(t, s) for t, s in waiting if t > passed]
        state.update((site.last[CLOUD], site.last[EDGE], site.mode, site.since, site.done, [float(t) for t, _ in waiting], [s for _, s in waiting]))
        ahead = [t for t in [*(t for t, _ in waiting), *site.due()] if t > passed]
        if ahead:
            state.setTimeoutTimestamp(max(int(min(ahead) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"site_id": [key[0]] * len(out), "t": [t for t, _ in out], "mode": [m for _, m in out]})

    keyed = heartbeats.withWatermark("at", delay).groupBy("site_id")
    kind = dict(heartbeats.dtypes)["site_id"]
    return keyed.applyInPandasWithState(update, f"site_id {kind}, t double, mode string", _SITE, "append", GroupStateTimeout.EventTimeTimeout)


def active_view(modes: DataFrame, heartbeats: DataFrame, positions: DataFrame, at: float, cfg: FailoverConfig, cache_s: float = 300.0, stale_s: float = 900.0) -> DataFrame:
    """(site_id, track_id, event_id, source, display): what each site shows at a time, from positions (site_id, source, track_id, event_id, t).

    LIVE: the latest position of each vessel from the source in charge, not older than stale_s.  For cache_s after a change, vessels that the
    source before showed, and the source in charge does not, stay on display: CACHED while that source is fresh, else STALE.
    """
    before = W.partitionBy("site_id").orderBy("t")
    modes = modes.where(F.col("t") <= at).withColumn("_from", F.lag("mode").over(before))
    latest = F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("t")))
    now = modes.withColumn("_r", latest).where("_r = 1").select(F.col("site_id").alias("_site"), F.col("mode").alias("_source"), F.lit(float(at)).alias("_at"))
    past = modes.where((F.col("t") > at - cache_s) & F.col("_from").isin(CLOUD, EDGE)).select(F.col("site_id").alias("_site"), F.col("_from").alias("_source"), F.col("t").alias("_at"))

    def shown(when: DataFrame) -> DataFrame:
        p = positions.join(when, (F.col("site_id") == F.col("_site")) & (F.col("source") == F.col("_source")))
        p = p.where((F.col("t") <= F.col("_at")) & (F.col("t") >= F.col("_at") - stale_s))
        first = F.row_number().over(W.partitionBy("site_id", "track_id").orderBy(F.desc("_at"), F.desc("t"), F.desc("event_id")))
        return p.withColumn("_r", first).where("_r = 1").select("site_id", "track_id", "event_id", "source")

    live = shown(now)
    kept = shown(past).join(live.select(F.col("site_id").alias("_s"), F.col("track_id").alias("_v")), (F.col("site_id") == F.col("_s")) & (F.col("track_id") == F.col("_v")), "left_anti")
    stale = F.when(F.col("source") == CLOUD, cfg.cloud_stale_s).otherwise(cfg.edge_stale_s)
    fresh = heartbeats.where((F.col("t") <= at) & (at - F.col("t") <= stale)).select(F.col("site_id").alias("_s"), F.col("source").alias("_o")).distinct().withColumn("_fresh", F.lit("CACHED"))
    kept = kept.join(fresh, (F.col("site_id") == F.col("_s")) & (F.col("source") == F.col("_o")), "left")
    return live.withColumn("display", F.lit("LIVE")).union(kept.select("site_id", "track_id", "event_id", "source", F.coalesce("_fresh", F.lit("STALE")).alias("display")))


def bounded(df: DataFrame, retention_s: float = 86_400.0, points: int = 720, vessels: int = 1000, stale_s: float = 3600.0) -> DataFrame:
    """The reports that a live buffer holds: of the newest `vessels` vessels not stale, the newest `points` of the last retention_s.

    Times are against the newest report of all.  The vessels kept are a bounded top list, sent to all.
    """
    newest = df.agg(F.max("t").alias("_now"))  # one row
    df = df.crossJoin(F.broadcast(newest)).where(F.col("t") >= F.col("_now") - retention_s)
    last = df.groupBy("track_id").agg(F.max("t").alias("_last"), F.max("_now").alias("_n")).where(F.col("_last") >= F.col("_n") - stale_s)
    some = last.orderBy(F.desc("_last"), "track_id").limit(vessels).select("track_id")
    w = W.partitionBy("track_id").orderBy(F.desc("t"), F.desc("event_id"))
    kept = df.join(F.broadcast(some), "track_id", "left_semi").withColumn("_r", F.row_number().over(w))
    return kept.where(F.col("_r") <= points).drop("_r", "_now")


class LiveAnalysis:
    """A foreachBatch handler: each batch joins the buffer, the buffer is analysed, and what is found is written under the batch's number.

    All writes of a batch replace what an earlier try of the same batch wrote, and a batch reads the buffer that the batch before it left: a batch
    that is run again leaves one copy.  folder is shared by all executors.
    """

    def __init__(self, folder: str, analyse: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] = bounded, least: int = 2):
        self.folder, self.analyse, self.keep, self.least = folder, analyse, keep, least

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/batch={number}"

    def _there(self, spark, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0 and self._there(spark, before := self._path("buffer", number - 1)):
            rows = spark.read.parquet(before).unionByName(batch)
        path = self._path("buffer", number)
        self.keep(rows).write.mode("overwrite").parquet(path)
        buffer = spark.read.parquet(path)
        self.analyse(buffer).write.mode("overwrite").parquet(self._path("alerts", number))
        n, tracks, bad = buffer.agg(F.count("*"), F.count_distinct("track_id"), F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull())).first()
        status = "unavailable" if not n else "insufficient" if tracks < self.least else "degraded" if 10 * bad > n else "ready"
        spark.createDataFrame([(number, n, tracks, status)], "batch long, reports long, vessels long, status string").write.mode("overwrite").parquet(self._path("status", number))
        if number > 1:  # a batch may be run again, the one before it not
            old = spark._jvm.org.apache.hadoop.fs.Path(self._path("buffer", number - 2))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
