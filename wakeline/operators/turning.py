"""Turning points of a signal with hysteresis, for tracks of any length: pieces are scanned apart and joined by their states.

A signal turns where it has gone back by at least the threshold from its extreme so far.  What is carried from one report to the next is
a state: the trend (1 up, -1 down, 0 not yet known), the extreme's value (for trend 0 the signal's first value), and its place.

A piece of the signal maps the state that comes in to the state that goes out, and needs only a summary for it.  Whatever
comes in, nothing changes until the first event: a new extreme, or a reversal.  From an event upwards on, the scan is one that enters
the piece going up from its first value, from an event downwards on, one that enters it going down.  So a summary is the two states
that these end in, and, for each trend, the few values that tell which event is first; its size does not grow with the piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = tuple[int, float, int]


def scan(values: np.ndarray, places: np.ndarray, state: State | None, threshold: float) -> tuple[list[tuple[int, int]], State | None]:
    """Turning points (place, trend that ended there) and the state after the values; no state: the signal begins."""
    turns = []
    for v, p in zip(values.tolist(), places.tolist(), strict=True):
        if state is None:
            state = (0, v, p)
            continue
        trend, extreme, at = state
        if trend == 0:
            if abs(v - extreme) >= threshold:
                state = (1 if v > extreme else -1, v, p)
        elif (v - extreme) * trend > 0:
            state = (trend, v, p)
        elif (extreme - v) * trend >= threshold:
            turns.append((at, trend))
            state = (-trend, v, p)
    return turns, state


def _beyond(gap: np.ndarray | float, need: float):
    """Whether a gap is an event: at least the threshold, or any at all where none is needed."""
    return gap >= need if need > 0 else gap > 0


def _first_up(values: np.ndarray, up: float, down: float) -> list[tuple[float, float]]:
    """(value, least before it) of the records by which it is told for any e whether `up` above e comes before `down` below it."""
    least = np.concatenate([[np.inf], np.minimum.accumulate(values)[:-1]])
    record = np.concatenate([[True], values[1:] > np.maximum.accumulate(values)[:-1]])
    high, low = values[record], least[record]
    reach = np.minimum(high - up, low + down)
    some = reach >= reach.max() - 1e-9 * (1 + abs(reach.max()))
    return [(float(a), float(b)) for a, b in zip(high[some], low[some], strict=True)]


def summary(values: np.ndarray, places: np.ndarray, threshold: float) -> dict:
    """What a piece does to any state."""
    out: dict = {}
    for name, trend in (("up", 1), ("down", -1)):
        out[name] = scan(values[1:], places[1:], (trend, float(values[0]), int(places[0])), threshold)[1]
    for trend, (up, down) in {1: (0.0, threshold), -1: (threshold, 0.0), 0: (threshold, threshold)}.items():
        out[f"first_{trend}"] = [*_first_up(values, up, down), *[(-a, -b) for a, b in _first_up(-values, down, up)]]
        out[f"ups_{trend}"] = len(_first_up(values, up, down))
    return out


def carried(state: State, s: dict, threshold: float) -> State:
    """The state behind a piece, from the state before it and the piece's summary."""
    trend, e, _ = state
    up, down = (0.0 if trend == 1 else threshold), (0.0 if trend == -1 else threshold)
    firsts, n = s[f"first_{trend}"], s[f"ups_{trend}"]
    if any(_beyond(high - e, up) and not _beyond(e - low, down) for high, low in firsts[:n]):
        return tuple(s["up"])
    if any(_beyond(e - low, down) and not _beyond(high - e, up) for low, high in firsts[n:]):
        return tuple(s["down"])
    return state


_PAIRS = "array<struct<a: double, b: double>>"
_STATE = "struct<trend: int, value: double, place: long>"
_SUMMARY = f"up {_STATE}, down {_STATE}, " + ", ".join(f"first_{k} {_PAIRS}, ups_{k} int".replace("-1", "m") for k in (1, -1, 0))


def turning_points(df: DataFrame, value: str, threshold: float, *, key: str = "track_id", time: str = "t", ident: str = "event_id", piece_s: float = 86_400.0) -> DataFrame:
    """(key, ident, kind): the turning points of value in order of (time, ident); kind 1 for peaks, -1 for troughs.

    Pieces are a track's reports of `piece_s` seconds, so a track with most of all rows is many tasks; a track's summaries, one a piece,
    meet in one.  Rows without key, time or value are passed over; ident is a long.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(time).cast("double").alias("_t"), F.col(ident).cast("long").alias("_id"), F.col(value).cast("double").alias("_v"))
    rows = rows.where(F.col("_key").isNotNull() & F.col("_t").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_piece", F.floor(F.col("_t") / piece_s))
    kind = dict(rows.dtypes)["_key"]
    order = [("_t", "ascending"), ("_id", "ascending")]

    def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.sort_by(order)
        return t["_v"].to_numpy(), t["_id"].to_numpy()

    def summed(keys, t):
        values, places = columns(t)
        s = summary(values, places, threshold)
        named = {k.replace("-1", "m"): v for k, v in s.items()}
        row = {"_key": keys[0].as_py(), "_piece": keys[1].as_py(), "first": (0, float(values[0]), int(places[0]))} | named
        row |= {"alone": scan(values, places, None, threshold)[1]}
        for k in ("first", "alone", "up", "down"):
            row[k] = dict(zip(("trend", "value", "place"), row[k], strict=True))
        for k in ("first_1", "first_m", "first_0"):
            row[k] = [{"a": a, "b": b} for a, b in row[k]]
        return pa.Table.from_pylist([row], schema=summed_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    summed_schema = f"_key {kind}, _piece long, first {_STATE}, alone {_STATE}, {_SUMMARY}"
    summed_arrow = to_arrow_schema(_parse_datatype_string(summed_schema))
    pieces = rows.groupBy("_key", "_piece").applyInArrow(summed, summed_schema)

    def folded(keys, t):
        """The state that each piece of a track is entered with."""
        state, out = None, {"_key": [], "_piece": [], "trend": [], "value": [], "place": []}
        for r in t.sort_by("_piece").to_pylist():
            out["_key"].append(r["_key"]), out["_piece"].append(r["_piece"])
            for k, v in zip(("trend", "value", "place"), state or (None, None, None), strict=True):
                out[k].append(v)
            if state is None:  # the track begins
                state = tuple(r["alone"].values())
                continue
            s = {k: tuple(r[k].values()) for k in ("up", "down")}
            for trend, name in ((1, "1"), (-1, "m"), (0, "0")):
                s[f"first_{trend}"], s[f"ups_{trend}"] = [(x["a"], x["b"]) for x in r[f"first_{name}"]], r[f"ups_{name}"]
            state = carried(state, s, threshold)
        return pa.table(out, schema=folded_arrow)

    folded_schema = f"_key {kind}, _piece long, trend int, value double, place long"
    folded_arrow = to_arrow_schema(_parse_datatype_string(folded_schema))
    entered = pieces.groupBy("_key").applyInArrow(folded, folded_schema)

    def turned(keys, t):
        values, places = columns(t)
        trend, value, place = (t[k][0].as_py() for k in ("trend", "value", "place"))
        turns, _ = scan(values, places, None if trend is None else (trend, value, place), threshold)
        return pa.table({"_key": [keys[0].as_py()] * len(turns), "_id": [p for p, _ in turns], "kind": [k for _, k in turns]}, schema=turned_arrow)

    turned_schema = f"_key {kind}, _id long, kind int"
    turned_arrow = to_arrow_schema(_parse_datatype_string(turned_schema))
    out = rows.join(entered, ["_key", "_piece"]).groupBy("_key", "_piece").applyInArrow(turned, turned_schema)
    return out.select(F.col("_key").alias(key), F.col("_id").alias(ident), "kind")
