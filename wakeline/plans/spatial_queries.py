"""Queries of nearest neighbours: stopping places, ports and coasts, and a raster of sea zones made from rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import context as C
from wakeline.operators import joins as J
from wakeline.operators import nearest as N
from wakeline.plans.registry import haversine, query
from wakeline.sources.fixes import fixes, zones

#: Points of the rings of some zones at most about `step` degrees apart, from their squares' corners.
def ring_points(kinds: str, step: str, name: str) -> str:
    return f"""{name}_e AS (SELECT zone_id, n, lat_c + half_deg * [-1, -1, 1, 1][n + 1] AS la, lon_c + half_deg * [-1, 1, 1, -1][n + 1] AS lo, lat_c + half_deg * [-1, 1, 1, -1][n + 1] AS lb, lon_c + half_deg * [1, 1, -1, -1][n + 1] AS lp FROM (SELECT *, unnest([0, 1, 2, 3]) AS n FROM zones WHERE kind IN ({kinds}))),
{name}_k AS (SELECT *, greatest(1, floor(sqrt((lp - lo) * (lp - lo) + (lb - la) * (lb - la)) / {step}))::BIGINT AS m FROM {name}_e),
{name} AS (SELECT zone_id, n * 100000 + k AS part, la + k / m * (lb - la) AS y, lo + k / m * (lp - lo) AS x FROM (SELECT *, unnest(range(0, m)) AS k FROM {name}_k))"""


STOPS = """nx AS (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t, event_id) - t AS dt FROM fixes), sv AS (SELECT CAST(floor(latitude / 0.25) AS INT) AS ci, CAST(floor(longitude / 0.25) AS INT) AS cj, track_id, sum(dt) AS s FROM nx WHERE coalesce(sog, 0) < 3 AND dt > 0 AND dt <= 86400 GROUP BY ALL),
sc AS (SELECT ci * 100000 + cj AS cell, (ci + 0.5e0) * 0.25e0 AS la, (cj + 0.5e0) * 0.25e0 AS lo FROM (SELECT ci, cj, count(*) AS vessels FROM sv WHERE s >= 3600 GROUP BY ALL) WHERE vessels >= 2)"""


@query("J4_nearest_stop", "WITH " + STOPS + ", d AS (SELECT event_id, cell, " + haversine("latitude", "longitude", "la", "lo") + " / 1852 AS nm FROM fixes CROSS JOIN sc), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY nm, cell) AS r FROM d) SELECT event_id, round(nm, 5) AS nm FROM r WHERE r = 1")
def nearest_stop(spark, sf_dir):
    """How far each report is from the middle of the nearest cell in which vessels use to stop."""
    df = fixes(spark, sf_dir)
    cells = C.stop_cells(df, size=0.25).where("vessels >= 2")
    sites = cells.select((F.col("ci") * 100_000 + F.col("cj")).cast("long").alias("cell"), ((F.col("ci") + 0.5) * 0.25).alias("site_lat"), ((F.col("cj") + 0.5) * 0.25).alias("site_lon"))
    return N.nearest_join(df, sites, "event_id", "cell").select("event_id", F.round("nm", 5).alias("nm"))


def zone_rings(spark, sf_dir, *kinds):
    return zones(spark, sf_dir).where(F.col("kind").isin(*kinds)).select(F.col("zone_id").alias("feature"), "ring")


#: Reports west, south, east and north of these have no known context.
COVERAGE = (118.6, 21.9, 122.4, 26.0)


@query(
    "J5_geographic_context",
    "WITH " + ring_points("'restricted', 'cable'", "0.04e0", "co") + ", inb AS (SELECT * FROM fixes WHERE longitude BETWEEN 118.6 AND 122.4 AND latitude BETWEEN 21.9 AND 26.0), cd AS (SELECT event_id, min(" + haversine("latitude", "longitude", "y", "x") + ") / 1000 AS coast_km FROM inb CROSS JOIN co GROUP BY event_id), pd AS (SELECT event_id, zone_id, " + haversine("latitude", "longitude", "lat_c", "lon_c") + " / 1000 AS km FROM inb JOIN zones ON kind = 'port'), pr AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, zone_id) AS r FROM pd), ar AS (SELECT event_id, string_agg(zone_id::VARCHAR, ',' ORDER BY zone_id) AS areas FROM inb JOIN zones ON abs(longitude - lon_c) <= half_deg AND abs(latitude - lat_c) <= half_deg GROUP BY event_id)"
    " SELECT f.event_id, CASE WHEN inb.event_id IS NULL THEN 'unknown' ELSE 'in_coverage' END AS coverage, round(coast_km, 3) AS coast_km, pr.zone_id AS port_id, round(km, 3) AS port_km, CASE WHEN inb.event_id IS NOT NULL THEN coalesce(areas, '') END AS areas FROM fixes f LEFT JOIN inb USING (event_id) LEFT JOIN cd USING (event_id) LEFT JOIN pr ON pr.event_id = f.event_id AND r = 1 LEFT JOIN ar ON ar.event_id = f.event_id",
)
def geographic_context(spark, sf_dir):
    """Distance to the coast, the nearest port and all areas that hold a report; unknown outside the coverage, never a guess."""
    df, z = fixes(spark, sf_dir).select("event_id", "latitude", "longitude"), zones(spark, sf_dir)
    known = df.where(geo.in_box(F.col("longitude"), F.col("latitude"), COVERAGE))
    coast = N.densify_rings(zone_rings(spark, sf_dir, "restricted", "cable"), "feature", 0.04).select((F.col("feature") * 1_000_000 + F.col("part")).alias("vertex"), "site_lat", "site_lon")
    ports = z.where("kind = 'port'").select(F.col("zone_id").alias("port_id"), F.col("lat_c").alias("site_lat"), F.col("lon_c").alias("site_lon"))
    km = F.col("nm") * (geo.NM_M / 1000)
    near_coast = N.nearest_join(known, coast, "event_id", "vertex").select("event_id", F.round(km, 3).alias("coast_km"))
    near_port = N.nearest_join(known, ports, "event_id", "port_id", parts=256).select("event_id", "port_id", F.round(km, 3).alias("port_km"))
    areas = J.in_squares(known, z).groupBy("event_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("zone_id")), lambda x: x.cast("string"))).alias("areas"))
    facts = known.select("event_id", F.lit("in_coverage").alias("coverage")).join(near_coast, "event_id").join(near_port, "event_id").join(areas, "event_id", "left")
    out = df.select("event_id").join(facts, "event_id", "left")
    coverage = F.coalesce("coverage", F.lit("unknown"))
    return out.select("event_id", coverage.alias("coverage"), "coast_km", "port_id", "port_km", F.when(F.col("coverage").isNotNull(), F.coalesce("areas", F.lit(""))).alias("areas"))


#: The grid of the sea zones: west, south, step in degrees, rows and columns.
GRID = (118.0, 21.5, 0.25, (21, 23))
RASTER = (
    ring_points("'protected', 'restricted'", "0.01e0", "ow") + ", " + ring_points("'fishing_ground'", "0.01e0", "ot") + ", nd AS (SELECT i * 23 + j AS node, i, j, 21.5e0 + i * 0.25e0 AS la, 118e0 + j * 0.25e0 AS lo FROM (SELECT unnest(range(0, 21)) AS i) CROSS JOIN (SELECT unnest(range(0, 23)) AS j)),"
    " wd AS (SELECT node, zone_id, part, " + haversine("la", "lo", "y", "x") + " / 1852 AS nm FROM nd CROSS JOIN ow), wr AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(nm, 9), zone_id, part) AS r FROM wd), td AS (SELECT node, min(" + haversine("la", "lo", "y", "x") + ") / 1852 AS onm FROM nd CROSS JOIN ot GROUP BY node),"
    " sq AS (SELECT node, bool_or(kind IN ('protected', 'restricted')) AS own, true AS land FROM nd JOIN zones ON kind IN ('protected', 'restricted', 'fishing_ground') AND lo >= lon_c - half_deg AND lo < lon_c + half_deg AND la >= lat_c - half_deg AND la < lat_c + half_deg GROUP BY node),"
    " raster AS (SELECT nd.node, i, j, zone_id AS feature, nm, least(nm, onm) AS coast_nm, coalesce(land, false) AS land, CASE WHEN own THEN 'TS' WHEN nm <= onm AND nm <= 12 THEN 'TS' WHEN nm <= onm AND nm <= 24 THEN 'CZ' WHEN nm <= onm AND nm <= 200 THEN 'EEZ' ELSE 'none' END AS zone FROM nd JOIN wr ON wr.node = nd.node AND r = 1 JOIN td ON td.node = nd.node LEFT JOIN sq ON sq.node = nd.node)"
)


def sea_zones(spark, sf_dir):
    lon0, lat0, step, shape = GRID
    return N.zone_raster(N.grid(spark, lon0, lat0, step, shape), zone_rings(spark, sf_dir, "protected", "restricted"), zone_rings(spark, sf_dir, "fishing_ground"))


@query("J7_zone_raster", "WITH " + RASTER + " SELECT node, i, j, round(nm, 4) AS nm, round(coast_nm, 4) AS coast_nm, land, zone FROM raster")
def zone_raster(spark, sf_dir):
    """Sea zones of a grid, from the rings of own and other land."""
    return sea_zones(spark, sf_dir).select("node", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("nm", 4).alias("nm"), F.round("coast_nm", 4).alias("coast_nm"), "land", "zone")


@query("J6_sea_zone", "WITH " + RASTER + ", p AS (SELECT event_id, greatest(0, least(20, round_even((latitude - 21.5e0) / 0.25e0, 0)))::BIGINT AS i, greatest(0, least(22, round_even((longitude - 118e0) / 0.25e0, 0)))::BIGINT AS j FROM fixes) SELECT event_id, zone, round(nm, 4) AS nm, land FROM p JOIN raster USING (i, j)")
def sea_zone(spark, sf_dir):
    """The sea zone of each report, read from the raster that the rings give."""
    lon0, lat0, step, shape = GRID
    out = J.raster_lookup(fixes(spark, sf_dir), sea_zones(spark, sf_dir).drop("node"), F.col("longitude"), F.col("latitude"), lon0, lat0, step, shape)
    return out.select("event_id", "zone", F.round("nm", 4).alias("nm"), "land")
