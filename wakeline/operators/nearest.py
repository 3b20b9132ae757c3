"""Exact nearest neighbours on the sphere by rings of cells, and rasters of the nearest feature made with them."""

from __future__ import annotations

from math import radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.scratch import Scratch

#: Finer cells along each side of a ring's cell, by which far sites are ruled out.
FINER = 8
#: Nautical miles of a degree of a great circle.
DEGREE_NM = radians(1) * geo.EARTH_M / geo.NM_M


def _cell(lat: Column, lon: Column, parts: int) -> tuple[Column, Column]:
    """Row and column of a grid of so many cells around the equator."""
    h = 360.0 / parts
    return F.floor((lat + 90.0) / h), F.pmod(F.floor((lon + 180.0) / h), F.lit(parts))


def nearest_join(points: DataFrame, sites: DataFrame, key: str, site: str, *, parts: int = 1024, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(key, site, nm): each point's nearest site, ties by smaller site; sites are (site, site_lat, site_lon), points are told apart by key.

    A point looks at the sites of its cell and the cells around it; all others are at least one cell's side away, so if the best found is nearer,
    it is the nearest.  Points that found none, or one farther, go on with cells twice as large, up to the whole sphere.  In a ring, sites
    count first by finer cells: one site of each, and the width of what the cell holds, bound the distances to all of them, and only cells
    that may hold the nearest are opened; many sites in one place cost a row a finer cell.  A round writes one table: what it found.

    Points without coordinates, and all points if there are no sites, have null site and nm.
    """
    spark = points.sparkSession
    scratch = Scratch(spark, "nearest")
    here = points.select(F.col(key).alias("_key"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    left = here.where(F.coalesce(geo.valid_coordinate(F.col("_lon"), F.col("_lat")), F.lit(False)))
    sites = sites.select(F.col(site).alias("_site"), F.col("site_lat").cast("double").alias("_y"), F.col("site_lon").cast("double").alias("_x"))
    sites = sites.where(geo.valid_coordinate(F.col("_x"), F.col("_y")))
    found = None
    while parts >= 2:
        h = 360.0 / parts
        i, j = _cell(F.col("_y"), F.col("_x"), parts * FINER)
        fine = sites.withColumns({"_i": i, "_j": j})
        wide = (F.max("_y") - F.min("_y") + (F.max("_x") - F.min("_x")) * F.cos(F.radians(F.least(F.min(F.abs("_y")), F.lit(90.0))))) * DEGREE_NM
        cells = fine.groupBy("_i", "_j").agg(F.min(F.struct("_site", "_y", "_x")).alias("_one"), wide.alias("_wide"))
        cells = cells.withColumns({"_ci": F.floor(F.col("_i") / FINER), "_cj": F.floor(F.col("_j") / FINER)})
        ring = sorted({d % parts for d in (-1, 0, 1)})
        ci, cj = _cell(F.col("_lat"), F.col("_lon"), parts)
        around = F.array(*[F.struct((ci + a).alias("_ci"), F.pmod(cj + b, F.lit(parts)).alias("_cj")) for a in (-1, 0, 1) for b in ring])
        seen = left.select("*", F.inline(around)).join(cells, ["_ci", "_cj"])
        nm = geo.haversine_nm(F.col("_lat"), F.col("_lon"), F.col("_one._y"), F.col("_one._x"))
        seen = seen.withColumn("_nm", nm).withColumn("_most", F.min("_nm").over(W.partitionBy("_key")))
        seen = seen.where(F.col("_nm") - F.col("_wide") <= F.col("_most") + 1e-6).select("_key", "_lat", "_lon", "_i", "_j")
        nm = geo.haversine_nm(F.col("_lat"), F.col("_lon"), F.col("_y"), F.col("_x"))
        best = seen.join(fine, ["_i", "_j"]).groupBy("_key").agg(F.min(F.struct(nm.alias("nm"), "_site")).alias("_best"))
        # what lies outside the ring: rows a side away, columns at least the distance to the meridian a side away
        side = F.degrees(F.asin(F.cos(F.radians("_lat")) * F.sin(F.radians(F.lit(min(h, 90.0))))))
        reach = F.lit(float("inf")) if parts == 2 else F.least(F.lit(h), side) * DEGREE_NM
        now = left.join(best, "_key", "left").withColumn("_done", F.coalesce(F.col("_best.nm") < reach, F.lit(parts == 2)))
        now = scratch.save(now.select("_key", "_lat", "_lon", F.col("_best._site").alias("_site"), F.col("_best.nm").alias("_nm"), "_done"), f"ring-{parts}")
        done = now.where("_done").select("_key", "_site", "_nm")
        found = done if found is None else found.union(done)
        left = now.where("not _done").select("_key", "_lat", "_lon")
        if left.isEmpty():
            break
        parts //= 2
    out = here.select("_key").join(found, "_key", "left")
    return out.select(F.col("_key").alias(key), F.col("_site").alias(site), F.col("_nm").alias("nm"))


def densify_rings(rings: DataFrame, ident: str, step_deg: float) -> DataFrame:
    """(ident, part, site_lat, site_lon): vertices of closed rings (arrays of structs lat, lon), with points between them at most about step_deg apart."""
    corner = F.posexplode("ring").alias("_n", "_a")
    edges = rings.select(ident, "ring", corner).withColumn("_b", F.col("ring")[F.pmod(F.col("_n") + 1, F.size("ring"))])
    dx, dy = F.col("_b.lon") - F.col("_a.lon"), F.col("_b.lat") - F.col("_a.lat")
    steps = F.greatest(F.lit(1), F.floor(F.sqrt(dx * dx + dy * dy) / step_deg).cast("int"))
    edges = edges.withColumn("_steps", steps).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_steps") - 1)))
    share = F.col("_k") / F.col("_steps")
    return edges.select(ident, (F.col("_n") * 100_000 + F.col("_k")).alias("part"), (F.col("_a.lat") + share * dy).alias("site_lat"), (F.col("_a.lon") + share * dx).alias("site_lon"))


def grid(spark, lon0: float, lat0: float, step: float, shape: tuple[int, int]) -> DataFrame:
    """(node, i, j, latitude, longitude): the nodes of a grid, rows by latitude."""
    i, j = F.floor(F.col("id") / shape[1]).cast("int"), (F.col("id") % shape[1]).cast("int")
    return spark.range(shape[0] * shape[1]).select(F.col("id").alias("node"), i.alias("i"), j.alias("j"), (F.lit(lat0) + i * step).alias("latitude"), (F.lit(lon0) + j * step).alias("longitude"))


#: Nautical miles from the baseline to the outer limits of the territorial sea, the contiguous zone and the economic zone.
LIMITS = (("TS", 12.0), ("CZ", 24.0), ("EEZ", 200.0))


def zone_raster(nodes: DataFrame, own: DataFrame, other: DataFrame, step_deg: float = 0.01) -> DataFrame:
    """(node, i, j, feature, nm, coast_nm, land, zone) of each grid node, from rings (feature, ring) of own and of other land.

    feature and nm: the nearest own ring and the distance to it; coast_nm: to any land; land: inside a ring; zone: TS, CZ, EEZ by distance
    where own land is no farther than other land, TS on own land, else none.  Distances are to the rings' points at step_deg.
    """

    def near(rings: DataFrame, name: str) -> DataFrame:
        points = densify_rings(rings, "feature", step_deg).select(F.struct("feature", "part").alias("site"), "site_lat", "site_lon")
        return nearest_join(nodes, points, "node", "site").select("node", F.col("site.feature").alias(f"_f_{name}"), F.col("nm").alias(f"_nm_{name}"))

    def on(rings: DataFrame, name: str) -> DataFrame:
        """Nodes inside a ring, met by the ring's box on one-degree cells."""
        lats, lons = F.col("ring.lat"), F.col("ring.lon")
        box = rings.select("ring", F.array_min(lats).alias("_s"), F.array_max(lats).alias("_n"), F.array_min(lons).alias("_w"), F.array_max(lons).alias("_e"))
        box = box.withColumn("_ci", F.explode(F.sequence(F.floor("_s"), F.floor("_n")))).withColumn("_cj", F.explode(F.sequence(F.floor("_w"), F.floor("_e"))))
        at = nodes.withColumns({"_ci": F.floor("latitude"), "_cj": F.floor("longitude")}).join(box, ["_ci", "_cj"])
        at = at.where(F.col("latitude").between(F.col("_s"), F.col("_n")) & F.col("longitude").between(F.col("_w"), F.col("_e")))
        return at.where(geo.in_polygon(F.col("latitude"), F.col("longitude"), F.col("ring"))).select("node").distinct().withColumn(f"_on_{name}", F.lit(True))

    out = nodes
    for rings, name in ((own, "own"), (other, "other")):
        out = out.join(near(rings, name), "node", "left").join(on(rings, name), "node", "left")
    nearer = F.col("_nm_own") <= F.coalesce("_nm_other", F.lit(float("inf")))
    zone = F.when(F.col("_on_own"), LIMITS[0][0])
    for name, limit in LIMITS:
        zone = zone.when(nearer & (F.col("_nm_own") <= limit), name)
    land = F.coalesce("_on_own", "_on_other", F.lit(False))
    return out.select("node", "i", "j", F.col("_f_own").alias("feature"), F.col("_nm_own").alias("nm"), F.least("_nm_own", "_nm_other").alias("coast_nm"), land.alias("land"), zone.otherwise("none").alias("zone"))
