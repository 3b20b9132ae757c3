"""Running sums and ranks over a whole table, by ranges of one sort: no task gets more than its range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.scratch import Scratch


def running_sum(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows of the same keys that stand before, in an order without ties.

    Rows are dealt to ranges of (keys, order) and written, as two steps need the same ranges; sums of ranges, a row for each range and
    key, give what stands before a range, and a window within the range the rest.
    """
    dealt = df.repartitionByRange(*[F.col(k).asc() for k in keys], *order).withColumn("_range", F.spark_partition_id())
    dealt = Scratch(df.sparkSession, "ranges").save(dealt, "dealt")
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_r"))
    within = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, same)
    return out.select(*df.columns, (F.col("_own") + F.col("_offset")).alias(name))


def row_numbers(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with each row's place, from 1, in an order without ties."""
    out = running_sum(df.withColumn("_one", F.lit(1).cast("long")), [], order, "_one", "_before")
    return out.select(*df.columns, (F.col("_before") + 1).alias(name))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with the error of the product carried into the sum, as a fused multiply-add has it; Spark has none.

    Halves of the factors give the product's error without rounding, a two-sum that of the addition.
    """

    def halves(x: Column) -> tuple[Column, Column]:
        t = x * F.lit(134_217_729.0)  # 2 ** 27 + 1
        return t - (t - x), x - (t - (t - x))

    (ah, al), (bh, bl) = halves(a), halves(b)
    p = a * b
    off = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    z = s - p
    return s + (((p - (s - z)) + (c - z)) + off)


def percentile_of(df: DataFrame, lists: dict[str, tuple[str, float]]) -> DataFrame:
    """df with name for each (array column in ascending order, share): the percentile that DuckDB's quantile_cont gives, to the last bit.

    For the values of small groups; a group's place between two values is told apart from a threshold just as the SQL does.
    """
    ends = {}
    for name, (values, share) in lists.items():
        at = (F.size(values) - 1) * F.lit(float(share))
        ends |= {f"_{name}_lo": F.get(values, F.floor(at).cast("int")), f"_{name}_hi": F.get(values, F.ceil(at).cast("int")), f"_{name}_f": at - F.floor(at)}
    out = df.withColumns(ends)
    lo, hi, f = (lambda name, end=end: F.col(f"_{name}_{end}") for end in ("lo", "hi", "f"))
    return out.withColumns({name: fused(lo(name), 1 - f(name), hi(name) * f(name)) for name in lists}).drop(*ends)


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], weight: str | None = None, as_sql: bool = False) -> DataFrame:
    """(keys, name, ...): exact percentiles with linear interpolation of value's non-null values, for each name and share.

    weight: a column of whole numbers; a row counts as so many.
    as_sql: interpolate as DuckDB's quantile_cont does, to the last bit, for results that are rounded at ties afterwards.

    Values are counted first, then ranked over ranges of one sort; each rank asked for is found by a partial aggregate.  No task
    holds a group's values, as an exact percentile aggregate does.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_m"))
    below = running_sum(counts, keys, [F.col("_v").asc()], "_m", "_below")
    total = below.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    placed = below.join(total, keys) if keys else below.crossJoin(F.broadcast(total))  # one row
    found = {}
    for name, share in shares.items():
        at = (F.col("_n") - 1) * F.lit(float(share))
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found[f"_{name}_{end}"] = F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_m")), F.col("_v")))
        found[f"_{name}_f"] = F.max(at - F.floor(at))
    out = placed.groupBy(*keys).agg(*[v.alias(k) for k, v in found.items()])

    def between(name: str) -> Column:
        lo, hi, f = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        return fused(lo, 1 - f, hi * f) if as_sql else lo + (hi - lo) * f

    return out.select(*keys, *[between(name).alias(name) for name in shares])
