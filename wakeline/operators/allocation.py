"""Priority allocation of demands to routes under capacities, for many scenarios and weight sets at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
#: Columns of the one table that a scenario's group is dealt as; what they mean depends on kind.
_LEDGER = "kind string, name string, port string, node string, commodity string, priority long, units double, cost double, eta double, risk double"


def ledger(demands: DataFrame, routes: DataFrame, ports: DataFrame, supplies: DataFrame, weights: DataFrame) -> DataFrame:
    """All that one allocation needs, as rows of (scenario, weights, w_cost, w_eta, w_risk, w_load, kind, ...).

    demands: (scenario, demand, node, commodity, priority, units); routes: (scenario, route, port, node, cost, eta, risk);
    ports: (scenario, port, units, handling); supplies: (scenario, port, commodity, units); weights: (weights, w_cost, w_eta, w_risk, w_load), a few rows.
    """
    parts = [
        demands.select("scenario", F.lit("demand").alias("kind"), F.col("demand").alias("name"), "node", "commodity", "priority", "units"),
        routes.select("scenario", F.lit("route").alias("kind"), F.col("route").alias("name"), "port", "node", "cost", "eta", "risk"),
        ports.select("scenario", F.lit("port").alias("kind"), F.col("port").alias("name"), "units", F.col("handling").alias("cost")),
        supplies.select("scenario", F.lit("supply").alias("kind"), F.lit("").alias("name"), "port", "commodity", "units"),
    ]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.crossJoin(F.broadcast(weights))  # each scenario once for each of a few weight sets


class _Books:
    """What is left in one scenario, and how good a route is now."""

    def __init__(self, g: pd.DataFrame):
        of = lambda kind: g[g["kind"] == kind]
        self.capacity = dict(zip(of("port")["name"], of("port")["units"], strict=True))
        self.full, self.handling = dict(self.capacity), dict(zip(of("port")["name"], of("port")["cost"], strict=True))
        supply = of("supply")
        self.stock = supply.groupby("commodity")["units"].sum().to_dict()
        self.entry = supply.groupby("commodity")["port"].agg(set).to_dict()
        self.routes = of("route").assign(total=lambda r: r["cost"] + r["port"].map(self.handling)).dropna(subset=["total"])
        self.demands = of("demand").sort_values(["priority", "units", "name"], ascending=[True, False, True])
        self.weight = {k: float(g[f"w_{k}"].iloc[0]) for k in ("cost", "eta", "risk", "load")}

    def options(self, node: str, commodity: str) -> pd.DataFrame:
        """Routes that may serve a demand, each measure scaled over them to 0 .. 1."""
        r = self.routes[(self.routes["node"] == node) & self.routes["port"].isin(self.entry.get(commodity, ()))].copy()
        fixed = 0.0
        for k, column in (("cost", "total"), ("eta", "eta"), ("risk", "risk")):
            low, high = r[column].min(), r[column].max()
            fixed = fixed + self.weight[k] * ((r[column] - low) / (high - low) if high > low else 0.0)
        return r.assign(fixed=fixed)

    def serve(self, demand) -> list[tuple]:
        """(step, port, route, units, score) of a demand, split over routes as their ports and the stock run out."""
        out, need, r = [], demand.units, self.options(demand.node, demand.commodity)
        while need > EPS and len(r):
            room = r["port"].map(self.capacity)
            r, room = r[room > EPS], room[room > EPS]
            stock = self.stock.get(demand.commodity, 0.0)
            if not len(r) or stock <= EPS:
                break
            scored = r.assign(score=r["fixed"] + self.weight["load"] * (1 - room / r["port"].map(self.full)))
            best = scored.sort_values(["score", "eta", "total", "risk", "name"]).iloc[0]
            units = min(need, self.capacity[best["port"]], stock)
            self.capacity[best["port"]] -= units
            self.stock[demand.commodity] = stock - units
            need -= units
            out.append((len(out) + 1, best["port"], best["name"], units, float(best["score"])))
        return out


RESULT = "scenario string, weights string, demand string, step int, port string, route string, units double, score double, unmet double"


def allocate(books: DataFrame) -> DataFrame:
    """(scenario, weights, demand, step, port, route, units, score, unmet) from a ledger.

    Demands are served by priority, larger ones first; each takes the best route that has room, and the next best for what is left.  A
    demand that gets nothing has one row of step 0.  Scenarios and weight sets are independent, so each pair is a group; within it the
    allocation is sequential by definition, over the places and goods of one scenario.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        state, rows = _Books(g), []
        for demand in state.demands.itertuples(index=False):
            got = state.serve(demand)
            unmet = max(0.0, demand.units - sum(x[3] for x in got))
            for x in got or [(0, None, None, 0.0, 0.0)]:
                rows.append((g["scenario"].iloc[0], g["weights"].iloc[0], demand.name, *x, unmet))
        return pd.DataFrame(rows, columns=["scenario", "weights", "demand", "step", "port", "route", "units", "score", "unmet"])

    kinds = dict(c.split(" ") for c in _LEDGER.split(", "))
    typed = books.select(F.col("scenario").cast("string").alias("scenario"), "weights", *[F.col(f"w_{k}").cast("double").alias(f"w_{k}") for k in ("cost", "eta", "risk", "load")], *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return typed.groupBy("scenario", "weights").applyInPandas(run, RESULT)
