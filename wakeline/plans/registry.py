"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The bridging views in SQL, and the constants that oracles share.
VIEWS = """
fixes AS (
  SELECT event_id, 'v' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS track_id, user_id, ts AS base_date_time, epoch_us(ts) / 1e6 AS t,
    118.5e0 + (user_id % 10) * 0.45e0 + ((event_id * 7919) % 1000) * 0.0004e0 AS longitude,
    21.8e0 + (user_id % 9) * 0.5e0 + ((event_id * 104729) % 1000) * 0.0004e0 AS latitude,
    CASE WHEN event_type = 'error' THEN NULL ELSE ((event_id * 31) % 200) / 10.0e0 END AS sog,
    CASE WHEN event_type = 'signup' THEN NULL ELSE ((event_id * 53) % 360) * 1.0e0 END AS cog,
    CASE WHEN event_type = 'view' THEN NULL ELSE ((event_id * 59) % 360) * 1.0e0 END AS heading,
    60 + user_id % 30 AS vessel_type, event_id % 9 AS status
  FROM events),
zones AS (
  SELECT n_nationkey AS zone_id, n_name AS name,
    CASE n_regionkey WHEN 0 THEN 'protected' WHEN 1 THEN 'cable' WHEN 2 THEN 'restricted' WHEN 3 THEN 'port' ELSE 'fishing_ground' END AS kind,
    118.7e0 + (n_nationkey % 5) * 0.9e0 AS lon_c, 22.0e0 + floor(n_nationkey / 5.0e0) * 0.9e0 AS lat_c, 0.15e0 AS half_deg
  FROM nation)
"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Metres in SQL; the sum of the arguments times 0 keeps nulls, which least() passes over."""
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * 6371008.8e0 * asin(sqrt(least(1.0e0, {a}))) + 0 * ({lat1} + {lon1} + {lat2} + {lon2}))"


def query(name: str, oracle: str | None = None, views: bool = True):
    """Register a function (spark, sf_dir) -> DataFrame, with SQL that may use the views fixes and zones."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            body = oracle.strip()
            recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
            rest = f", {body[4:].lstrip().removeprefix('RECURSIVE').lstrip()}" if body.upper().startswith("WITH") else f" {body}"
            ORACLES[name] = f"WITH {recursive}{VIEWS.strip()}{rest}" if views else body
        return f

    return keep
