"""Rows of several providers made one row a vessel, without trusting an identity that contradicts itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of texts joined by bars, empty where they are null."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def reconcile(rows: DataFrame, valid_mmsi: Column, print_: Column, latest: Column) -> DataFrame:
    """(kind, value, trusted_mmsi, n, latest) for each vessel; rows have uuid, mmsi, imo.

    A row goes by its uuid.  Without one it goes to the only uuid that its valid MMSI occurs with; by the MMSI if there is none; and, if
    there are several, by its fingerprint alone, as ambiguous.  Without a valid MMSI it goes by its IMO number, else by its fingerprint.
    A vessel's MMSI is trusted if its rows agree on it, none has an invalid one, and it occurs with one uuid at most.  latest:
    the vessel's largest struct of that order.

    How many uuids an MMSI occurs with is one small aggregate, joined back by MMSI; nothing is compared pairwise.
    """
    rows = rows.withColumns({"_ok": F.when(valid_mmsi, F.col("mmsi")), "_uuid": F.when(F.col("uuid") != "", F.col("uuid")), "_print": print_, "_latest": latest})
    uses = rows.where("_uuid is not null and _ok is not null").groupBy(F.col("_ok").alias("_m")).agg(F.count_distinct("_uuid").alias("_n"), F.min("_uuid").alias("_only"))
    rows = rows.join(uses, F.col("_ok") == F.col("_m"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    key = (
        F.when(F.col("_uuid").isNotNull(), pair("uuid", F.col("_uuid")))
        .when(F.col("_ok").isNotNull() & (F.col("_n") == 1), pair("uuid", F.col("_only")))
        .when(F.col("_ok").isNotNull() & (F.col("_n") == 0), pair("mmsi", F.col("_ok")))
        .when(F.col("_ok").isNotNull(), pair("ambiguous", F.col("_print")))
        .when(F.col("imo").isNotNull(), pair("imo", F.col("imo")))
        .otherwise(pair("fallback", F.col("_print")))
    )
    invalid = F.count_if(F.col("mmsi").isNotNull() & F.col("_ok").isNull())
    one = (F.min("_ok") == F.max("_ok")) & (invalid == 0) & (F.max(F.when(F.col("_ok").isNotNull(), F.col("_n"))) <= 1)
    out = rows.groupBy(key.alias("_key")).agg(F.when(one, F.min("_ok")).alias("trusted_mmsi"), F.count("*").alias("n"), F.max("_latest").alias("latest"))
    return out.select("_key.kind", "_key.value", "trusted_mmsi", "n", "latest")
