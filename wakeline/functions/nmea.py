"""NMEA sentences as column expressions: checksum, fields, and messages put together from fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = r"^!([^*]+)\*([0-9A-Fa-f]{2})\s*$"


def checksum_ok(line: Column) -> Column:
    """Whether the two hex digits behind the star are the exclusive or of the characters between mark and star."""
    body, want = F.regexp_extract(line, SENTENCE, 1), F.regexp_extract(line, SENTENCE, 2)
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.ascii(c))
    got = F.aggregate(codes, F.lit(0), lambda s, c: s.bitwiseXOR(c))
    return F.coalesce((F.length(body) > 0) & (F.lpad(F.hex(got.cast("long")), 2, "0") == F.upper(want)), F.lit(False))


def fragments(df: DataFrame, line: str = "line") -> DataFrame:
    """df with the fields of well-formed sentences: talker, total, number, group, channel, payload; others are dropped."""
    part = F.split(F.regexp_extract(F.col(line), SENTENCE, 1), ",")
    out = df.where(checksum_ok(F.col(line))).withColumn("_f", part).where(F.size("_f") == 7)
    names = {"talker": "string", "total": "int", "number": "int", "group": "string", "channel": "string", "payload": "string"}
    out = out.withColumns({n: F.get("_f", F.lit(k)).try_cast(t) for k, (n, t) in enumerate(names.items())}).drop("_f")
    return out.where((F.col("total").between(1, 9)) & F.col("number").between(1, F.col("total")) & (F.length("payload") > 0))


def messages(df: DataFrame, source: str = "source", at: str = "t", window_s: float = 15.0) -> DataFrame:
    """Whole messages of fragments(): single ones, and groups whose fragments came in order within window_s of the first.

    A group's rows are told from later ones with the same number by their start: a fragment numbered 1 opens a new one.
    """
    from pyspark.sql.window import Window as W

    keys = [source, "talker", "total", "group", "channel"]
    one = df.where("total = 1").select(source, F.col(at).alias(at), "channel", "payload")
    w = W.partitionBy(*keys).orderBy(at, "number")
    many = df.where("total > 1").withColumn("_k", F.sum((F.col("number") == 1).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    many = many.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_k").orderBy(at, "number")))
    g = many.where("_k > 0").groupBy(*keys, "_k").agg(F.count("*").alias("_n"), F.count_if(F.col("_i") == F.col("number")).alias("_right"), F.min(at).alias("_a"), F.max(at).alias("_z"), F.array_sort(F.collect_list(F.struct("number", "payload"))).alias("_p"))
    whole = g.where((F.col("_n") == F.col("total")) & (F.col("_right") == F.col("total")) & (F.col("_z") - F.col("_a") <= window_s))
    return one.unionByName(whole.select(source, F.col("_a").alias(at), "channel", F.array_join(F.transform("_p", lambda x: x["payload"]), "").alias("payload")))
