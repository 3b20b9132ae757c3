"""Loitering in its context, and the whole analysis: reports and what history has taught, to numbered events and alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo, identity
from wakeline.operators import context as C
from wakeline.operators import detect as D
from wakeline.operators import joins as J
from wakeline.operators import nearest as N
from wakeline.operators import sequences as Q
from wakeline.operators import survey as V
from wakeline.scratch import Scratch


@dataclass(frozen=True)
class LoiterConfig:
    radius_nm: float = 2.0
    min_s: float = 5400.0
    gap_s: float = 2700.0
    least: int = 4
    max_kn: float = 4.0
    whole: float = 0.85
    still: float = 0.6
    benign: float = 0.6
    near_nm: float = 3.0
    others: int = 3


#: What a type of vessel adds to or takes from the severity of loitering, anywhere and within half a mile of a port.
TYPE_WEIGHT = {"tanker": 5, "cargo": 5, "fishing": -15, "pleasure": -20}
PORT_WEIGHT = {"passenger": -12, "ferry": -12, "tug": -22, "pilot": -22, "sar": -22, "service": -22, "dredger": -22}


def learned_context(history: DataFrame, cell: float = 0.25, least_stops: int = 2, leg_s: float = 1800.0) -> dict[str, DataFrame]:
    """What history teaches, each a table written once: traffic and stop cells, habitual spots, usual silences and silences by type.

    stops: cells in which several vessels use to stop; spots: (track_id, ci, cj) of a vessel's own stops; habits: each vessel's 95th percentile gap.  Legs of
    up to leg_s seconds count as traffic all along.
    """
    scratch = Scratch(history.sparkSession, "context")
    keep = lambda df, name: scratch.save(df, name)
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    dt = F.lead("t").over(w) - F.col("t")
    slow = history.withColumn("dt", dt).where((F.coalesce("sog", F.lit(0.0)) < 3.0) & (F.col("dt") > 0) & (F.col("dt") <= 86_400.0))
    at = [geo.cell(F.col("latitude"), cell).alias("ci"), geo.cell(F.col("longitude"), cell).alias("cj")]
    spots = slow.groupBy("track_id", *at).agg(F.sum("dt").alias("s")).where("s >= 3600").drop("s")
    spots = keep(spots, "spots")
    return {
        "traffic": keep(C.traffic_cells(C.densify(history, max_dt_s=leg_s)), "traffic"),
        "spots": spots,
        "stops": keep(spots.groupBy("ci", "cj").agg(F.count("*").alias("vessels")).where(F.col("vessels") >= least_stops), "stops"),
        "habits": keep(C.gap_habits(history), "habits"),
        "intervals": keep(C.expected_interval(history), "intervals"),
    }


def in_context(df: DataFrame, zones: DataFrame, learned: dict[str, DataFrame], cell: float = 0.25) -> DataFrame:
    """df with benign (in a port's square or a cell where vessels use to stop), fishing and sensitive (in such a zone), a row each."""
    at = J.in_squares(df.select("event_id", "longitude", "latitude"), zones)
    kinds = at.groupBy("event_id").agg(*[F.bool_or(F.col("kind").isin(*k)).alias(n) for n, k in (("_port", ("port",)), ("fishing", ("fishing_ground",)), ("sensitive", ("protected", "cable", "restricted")))])
    stops = learned["stops"].select("ci", "cj", F.lit(True).alias("_stop"))
    df = df.withColumns({"ci": geo.cell(F.col("latitude"), cell), "cj": geo.cell(F.col("longitude"), cell)}).join(stops, ["ci", "cj"], "left").join(kinds, "event_id", "left")
    no = F.lit(False)
    return df.withColumns({"benign": F.coalesce("_port", no) | F.coalesce("_stop", no), "fishing": F.coalesce("fishing", no), "sensitive": F.coalesce("sensitive", no)}).drop("_port", "_stop")


def loitering(df: DataFrame, zones: DataFrame, learned: dict[str, DataFrame], cfg: LoiterConfig, cell: float = 0.25) -> DataFrame:
    """Stays that their surroundings don't explain, as events with severity and confidence.

    df: reports as in_context gives them, with ship_type.  A stay is passed over if it makes up nearly all of the vessel's track, if the vessel
    declares rest, where vessels use to stop, where a fishing vessel fishes, and inside sensitive zones, which tell by themselves.
    """
    scratch = Scratch(df.sparkSession, "loitering")
    stays = scratch.save(Q.stay_points(df, cfg.radius_nm, cfg.min_s, cfg.gap_s, cfg.least, cfg.max_kn).drop("n", "latitude", "longitude"), "stays")
    spans = df.groupBy("track_id").agg((F.max("t") - F.min("t")).alias("_span"))
    rows = df.select("track_id", "t", "latitude", "longitude", "sog", "status", "benign", "fishing", "sensitive", "ship_type")
    inside = J.range_bucket_join(rows, stays.select("track_id", "t0", "t1"), ["track_id"], "t", "t0", "t1", max(cfg.min_s, 3600.0))
    share = lambda c: F.avg(F.col(c).cast("double"))
    rest = F.avg(F.coalesce(F.col("status").isin(*D.STATIC), F.lit(False)).cast("double"))
    g = inside.groupBy("track_id", "t0", "t1").agg(
        F.count("*").alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.percentile("sog", 0.5).alias("median_kn"), rest.alias("_rest"),
        (F.count("sog") / F.count("*")).alias("_valid"), share("benign").alias("_benign"), share("fishing").alias("_fishing"), share("sensitive").alias("_sensitive"), F.min("ship_type").alias("ship_type"),
    )
    g = g.join(spans, "track_id")
    dur = F.col("t1") - F.col("t0")
    g = g.where((dur < cfg.whole * F.col("_span")) & (F.col("_rest") < cfg.still) & (F.col("_benign") <= cfg.benign) & ~((F.col("_fishing") > 0.5) & (F.col("ship_type") == "fishing")) & (F.col("_sensitive") <= 0.5))
    g = scratch.save(g.withColumn("event", F.concat_ws("@", "track_id", F.col("t0").cast("string"))), "facts")
    for name, kinds in (("port", ("port",)), ("zone", ("protected", "cable", "restricted"))):
        sites = zones.where(F.col("kind").isin(*kinds)).select("zone_id", F.col("lat_c").alias("site_lat"), F.col("lon_c").alias("site_lon"), "half_deg")
        near = N.nearest_join(g, sites.drop("half_deg"), "event", "zone_id", parts=256)
        edge = sites.agg(F.max("half_deg").alias("h")).first()["h"] or 0.0
        g = g.join(near.select("event", F.greatest(F.lit(0.0), F.col("nm") - edge * 60).alias(f"{name}_nm")), "event", "left")
    spot = learned["spots"].select("track_id", "ci", "cj", F.lit(True).alias("_own"))
    g = g.withColumns({"ci": geo.cell(F.col("latitude"), cell), "cj": geo.cell(F.col("longitude"), cell)}).join(spot, ["track_id", "ci", "cj"], "left")
    weigh = lambda table: F.coalesce(*[F.when(F.col("ship_type") == k, v) for k, v in table.items()], F.lit(0))
    sev = 40 + 30 * F.least(F.lit(1.0), (dur - cfg.min_s) / (2 * cfg.min_s)) + F.when(F.col("port_nm") > 15, 10).otherwise(0) + F.when(F.col("zone_nm") <= 10, 18).otherwise(0)
    sev = sev + weigh(TYPE_WEIGHT) + F.when(F.col("port_nm") < 0.5, weigh(PORT_WEIGHT)).otherwise(0) - F.when(F.col("_own"), 28).otherwise(0) - F.when(F.col("_fishing") > 0.5, 10).otherwise(0)
    every = dur / (F.col("n") - 1)
    quality = D.clip(F.when(every <= 400, 1.0).when(every <= 900, 0.75).otherwise(0.5) * (0.6 + 0.4 * F.col("_valid")), 0.1, 1.0)
    return g.select("track_id", F.lit("loitering").alias("kind"), "t0", "t1", "latitude", "longitude", D.clip(sev).alias("severity"), D.clip(0.35 + 0.45 * quality, 0.1, 0.95).alias("confidence"), "port_nm", "zone_nm", F.coalesce("_own", F.lit(False)).alias("own_spot"))


def gatherings(events: DataFrame, cfg: LoiterConfig) -> DataFrame:
    """Loitering events with others: how many other notable loiterers were near at the same time; with enough of them it is a gathering, less severe.

    Events meet by day and by cells around them, each pair once; a vessel's own spot explains itself and isn't adjusted.
    """
    key = F.concat_ws("@", "track_id", F.col("t0").cast("string"))
    events = Scratch(events.sparkSession, "gatherings").save(events.withColumn("_key", key), "events")
    notable = events.where("severity >= 35").select("_key", "track_id", "t0", "t1", "latitude", "longitude")
    days = F.explode(F.sequence(F.floor(F.col("t0") / 86_400), F.floor(F.col("t1") / 86_400)))
    pairs = J.cell_self_join(notable.withColumn("_day", days), ["_day"], "_key", "longitude", "latitude", cfg.near_nm / 30, ("track_id", "t0", "t1"))
    near = (F.col("track_id") != F.col("track_id2")) & (F.col("t0") <= F.col("t12")) & (F.col("t02") <= F.col("t1"))
    pairs = pairs.where(near & (geo.haversine_nm(F.col("latitude"), F.col("longitude"), F.col("latitude2"), F.col("longitude2")) <= cfg.near_nm)).select("_key", "_key2").distinct()
    both = pairs.select(F.col("_key").alias("_k")).union(pairs.select("_key2")).groupBy("_k").agg(F.count("*").alias("others"))
    out = events.join(both, F.col("_key") == F.col("_k"), "left").withColumn("others", F.coalesce("others", F.lit(0)))
    less = (F.col("others") >= cfg.others) & ~F.col("own_spot")
    return out.withColumn("severity", F.when(less, D.clip(F.col("severity") - 18)).otherwise(F.col("severity"))).drop("_key", "_k")


@dataclass(frozen=True)
class AnalysisConfig:
    detect: D.DetectConfig = field(default_factory=D.DetectConfig)
    loiter: LoiterConfig = field(default_factory=LoiterConfig)
    survey: V.SurveyConfig = field(default_factory=V.SurveyConfig)
    base: tuple[tuple[str, float], ...] = (("cable", 58.0), ("restricted", 55.0), ("protected", 45.0))
    least: int = 3
    link_s: float = 21_600.0


def eligible(df: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Reports with coordinates of vessels with enough of them."""
    df = df.where(geo.valid_coordinate(F.col("longitude"), F.col("latitude")))
    return df.withColumn("_n", F.count("*").over(W.partitionBy("track_id"))).where(F.col("_n") >= cfg.least).drop("_n")


EVENT = ("track_id", "kind", "t0", "t1", "severity", "confidence")


def run_all(df: DataFrame, zones: DataFrame, learned: dict[str, DataFrame], cfg: AnalysisConfig) -> DataFrame:
    """(event, track_id, kind, t0, t1, severity, confidence): what all detectors find in df, numbered by start.

    A silence that a vessel's own history makes routine is left out.  Reports are put in context once, for all detectors.
    """
    scratch = Scratch(df.sparkSession, "analysis")
    df = scratch.save(in_context(eligible(df, cfg), zones, learned).withColumn("ship_type", identity.ship_category(F.col("vessel_type"))), "reports")
    habits = learned["habits"].select("track_id", "gap_p95")
    gaps = D.gaps(df, cfg.detect).join(habits, "track_id", "left").where(F.col("gap_p95").isNull() | (F.col("t1") - F.col("t0") > 1.25 * F.col("gap_p95")))
    survey = V.survey_events(df.where(~identity.is_exempt(F.col("ship_type"), F.lit(None).cast("string"))), cfg.survey)
    found = [gaps, D.jumps(df, cfg.detect), D.status_mismatch(df, cfg.detect), D.zone_entries(df, zones, cfg.detect, dict(cfg.base)), gatherings(loitering(df, zones, learned, cfg.loiter), cfg.loiter), survey]
    out = None
    for e in found:
        out = e.select(*EVENT) if out is None else out.union(e.select(*EVENT))
    from wakeline.operators.ranges import row_numbers

    out = scratch.save(out, "events")
    return row_numbers(out, [F.col("t0"), F.col("track_id"), F.col("kind"), F.col("t1")], "event")


def alerts(events: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """(track_id, alert, t0, t1, n_events, kinds, risk, level): a vessel's events that follow each other closely, with their risk."""
    grouped = D.link_groups(events, cfg.link_s)
    facts = grouped.groupBy("track_id", "alert").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("n_events"))
    return facts.join(D.risk(grouped, ["track_id", "alert"]), ["track_id", "alert"])
