"""Range, spatial and as-of joins as equi-joins, so that they shuffle by key and never compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def range_bucket_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, bucket: float) -> DataFrame:
    """Points with the spans [lo, hi] of the same keys that hold them.

    Spans are exploded over the buckets that they touch (choose bucket near the usual span), points fall in one; column names of
    the two sides must differ but for keys.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    return p.join(s, [*keys, "_b"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_b")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bucket: float, slack: float = 0.0) -> DataFrame:
    """Pairs of spans of the same keys that overlap (ends within slack of each other count), each pair once."""
    l_ = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col(a[0]) - slack) / bucket), F.floor((F.col(a[1]) + slack) / bucket))))
    r = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(b[0]) / bucket), F.floor(F.col(b[1]) / bucket))))
    meet = (F.col(a[0]) - slack <= F.col(b[1])) & (F.col(a[1]) + slack >= F.col(b[0]))
    first = F.floor(F.greatest(F.col(a[0]) - slack, F.col(b[0])) / bucket)  # the first common bucket reports the pair
    return l_.join(r, [*keys, "_b"]).where(meet & (F.col("_b") == first)).drop("_b")


def cell_self_join(df: DataFrame, keys: list[str], ident: str, x: str, y: str, size: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (ident < ident2) within the same keys whose cells of the given size touch; size is at least the radius wanted.

    One side is exploded over its nine neighbour cells, so candidates meet by an equi-join on (keys, cell).
    """
    cols = [*keys, ident, x, y, *extra]
    one = df.select(*cols).withColumns({"_i": F.floor(F.col(x) / size), "_j": F.floor(F.col(y) / size)})
    near = F.array(*[F.struct((F.col("_i") + a).alias("_i"), (F.col("_j") + b).alias("_j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    two = one.select(*keys, *[F.col(c).alias(f"{c}2") for c in (ident, x, y, *extra)], F.inline(near))
    return one.join(two, [*keys, "_i", "_j"]).where(F.col(ident) < F.col(f"{ident}2")).drop("_i", "_j")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], after: str = "_order") -> DataFrame:
    """left with the values of the last row of right at or before its time (``at`` on both sides).

    One union and one window per key: both sides are sorted together and the last right row is carried forward, with its time as
    ``<at>_found``.  Ties in right go to the row that is largest by values.
    """
    carried = F.struct(F.col(at).alias("_t"), *values)
    a = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType)})
    b = right.select(*keys, at, F.lit(0).alias("_side"), carried.alias("_r"))
    w = W.partitionBy(*keys).orderBy(at, "_side", F.col("_r")).rowsBetween(W.unboundedPreceding, 0)
    both = b.unionByName(a, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, F.col("_r._t").alias(f"{at}_found"), *[F.col(f"_r.{v}").alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """As asof_backward, for the first row of right at or after the time of left."""
    flip = lambda df: df.withColumn(at, -F.col(at))
    out = asof_backward(flip(left), flip(right), keys, at, values)
    return out.withColumns({at: -F.col(at), f"{at}_found": -F.col(f"{at}_found")})


def interpolate(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], bracket: float) -> DataFrame:
    """left with the values of right at its times, linear between the rows around; null unless the nearer is within bracket."""
    back = asof_backward(left, right, keys, at, values)
    back = back.withColumnsRenamed({f"{at}_found": "_t0", **{v: f"_a_{v}" for v in values}})
    ahead = asof_forward(back, right, keys, at, values).withColumnsRenamed({f"{at}_found": "_t1", **{v: f"_b_{v}" for v in values}})
    t = F.col(at)
    ok = F.least(t - F.col("_t0"), F.col("_t1") - t) <= bracket
    share = F.when(F.col("_t1") > F.col("_t0"), (t - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))).otherwise(0.0)
    return ahead.select(*left.columns, *[F.when(ok, F.col(f"_a_{v}") + share * (F.col(f"_b_{v}") - F.col(f"_a_{v}"))).alias(v) for v in values])


def raster_lookup(df: DataFrame, raster: DataFrame, lon: Column, lat: Column, lon0: float, lat0: float, step: float, shape: tuple[int, int]) -> DataFrame:
    """df with the raster's columns at the nearest grid point (rounded half to even, clipped to the grid); raster is keyed by (i, j)."""
    i = F.greatest(F.lit(0), F.least(F.lit(shape[0] - 1), F.rint((lat - lat0) / step).cast("int")))
    j = F.greatest(F.lit(0), F.least(F.lit(shape[1] - 1), F.rint((lon - lon0) / step).cast("int")))
    return df.withColumns({"_i": i, "_j": j}).join(raster.withColumnsRenamed({"i": "_i", "j": "_j"}), ["_i", "_j"], "left").drop("_i", "_j")


def in_squares(df: DataFrame, squares: DataFrame) -> DataFrame:
    """Reports with the squares (lon_c, lat_c, half_deg: at most half a degree) that hold them, by an equi-join on one-degree cells."""
    s = squares.withColumn("_ij", F.explode(F.array_distinct(F.array(*[F.struct(F.floor(F.col("lon_c") + a * F.col("half_deg")).alias("x"), F.floor(F.col("lat_c") + b * F.col("half_deg")).alias("y")) for a in (-1, 1) for b in (-1, 1)]))))
    s = s.select("*", F.col("_ij.x").alias("_x"), F.col("_ij.y").alias("_y")).drop("_ij")
    p = df.withColumns({"_x": F.floor("longitude"), "_y": F.floor("latitude")})
    inside = (F.abs(F.col("longitude") - F.col("lon_c")) <= F.col("half_deg")) & (F.abs(F.col("latitude") - F.col("lat_c")) <= F.col("half_deg"))
    return p.join(s, ["_x", "_y"]).where(inside).drop("_x", "_y")
