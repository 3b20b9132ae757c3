"""Readers for position archives in several dialects, and writers that carry a manifest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Names under which archives carry each canonical column.
ALIASES = {
    "vessel_id": ("mmsi", "MMSI", "vessel_id", "vesselId"),
    "base_date_time": ("base_date_time", "BaseDateTime", "timestamp", "time", "t", "ts"),
    "longitude": ("longitude", "lon", "LON", "x"),
    "latitude": ("latitude", "lat", "LAT", "y"),
    "sog": ("sog", "SOG", "speed"),
    "cog": ("cog", "COG", "course"),
    "heading": ("heading", "Heading", "true_heading"),
    "vessel_type": ("vessel_type", "VesselType", "ship_type", "shiptype"),
}


def select_mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Canonical columns by an explicit mapping canonical -> source; ids trimmed, times parsed, numbers coerced (bad ones null)."""
    missing = [s for s in mapping.values() if s not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = []
    for name, source in mapping.items():
        c = F.col(f"`{source}`")
        if name == "vessel_id":
            c = F.trim(c.cast("string"))
        elif name == "base_date_time":
            c = parse_utc(c)
        elif name in ("longitude", "latitude", "sog", "cog", "heading", "vessel_type"):
            c = c.cast("string").try_cast("double")
        out.append(c.alias(name))
    return df.select(*out)


def select_by_alias(df: DataFrame) -> DataFrame:
    """As select_mapped, with source names found among ALIASES."""
    mapping = {name: next((a for a in names if a in df.columns), None) for name, names in ALIASES.items()}
    need = [n for n in ("vessel_id", "base_date_time", "longitude", "latitude") if not mapping[n]]
    if need:
        raise ValueError(f"no column for: {need}")
    return select_mapped(df, {k: v for k, v in mapping.items() if v})


def parse_utc(c: Column) -> Column:
    """Timestamps from text in several forms, or from seconds or milliseconds since 1970 (above 1e11: milliseconds); invalid is null."""
    text = c.cast("string")
    number = text.try_cast("double")
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSS][XXX]", "dd/MM/yyyy HH:mm:ss")
    from_number = F.timestamp_micros((F.when(number > 1e11, number / 1000).otherwise(number) * 1_000_000).cast("long"))
    return F.when(number.isNotNull(), from_number).otherwise(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]))


def sentinels_to_null(df: DataFrame) -> DataFrame:
    """Speed 102.3 and above and course 360 and above are "not available"; reports at 0, 0 are dropped."""
    df = df.where(~((F.col("latitude") == 0) & (F.col("longitude") == 0)))
    return df.withColumns({"sog": F.when(F.col("sog") < 102.3, F.col("sog")), "cog": F.when(F.col("cog") < 360, F.col("cog"))})


def comma_decimal(c: Column) -> Column:
    return F.regexp_replace(c, ",", ".").try_cast("double")


def read_national_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless national archive: day first times, comma decimals, class A and B transponders only."""
    raw = spark.read.csv(path, header=False)
    a = raw.where(F.col("_c1").isin("Class A", "Class B"))
    return a.select(parse_utc(F.col("_c0")).alias("base_date_time"), F.trim("_c2").alias("vessel_id"), comma_decimal(F.col("_c3")).alias("latitude"), comma_decimal(F.col("_c4")).alias("longitude"), F.col("_c5").alias("status"), comma_decimal(F.col("_c7")).alias("sog"), comma_decimal(F.col("_c8")).alias("cog"))


def read_nested_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily JSON {entries: [{dataset: [record, ...]}]} as one row per record, with the dataset's name as a column."""
    record = "struct<date:string,lat:double,lon:double,hours:double,vesselId:string,mmsi:string,shipName:string,flag:string>"
    raw = spark.read.schema(f"entries array<map<string,array<{record}>>>").json(path, multiLine=True)
    per = raw.select(F.explode("entries").alias("e")).select(F.explode("e").alias("dataset", "records"))
    return per.select("dataset", F.inline_outer("records")).where(F.col("vesselId").isNotNull() | F.col("lat").isNotNull())


def wkb_points(df: DataFrame, column: str) -> DataFrame:
    """Adds longitude and latitude of a WKB point column, in either byte order; other, short or null blobs give null."""

    def run(batches):
        import numpy as np

        for b in batches:
            x, y = np.full(len(b), np.nan), np.full(len(b), np.nan)
            for i, blob in enumerate(b.column(0).to_pylist()):
                if blob is None or len(blob) < 21:
                    continue
                order = "<" if blob[0] == 1 else ">"
                if np.frombuffer(blob, f"{order}u4", 1, 1)[0] & 0xFFFF != 1:
                    continue
                skip = 4 if np.frombuffer(blob, f"{order}u4", 1, 1)[0] & 0x20000000 else 0
                if len(blob) >= 21 + skip:
                    x[i], y[i] = np.frombuffer(blob, f"{order}f8", 2, 5 + skip)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, from_pandas=True), pa.array(y, from_pandas=True)], [*b.schema.names[1:], "longitude", "latitude"])

    schema = StructType([*df.schema.fields, StructField("longitude", DoubleType()), StructField("latitude", DoubleType())])
    return df.select(F.col(column).alias("_wkb"), *df.columns).mapInArrow(run, schema)


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of EPSG:3857 metres."""
    r = 6_378_137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - F.lit(3.141592653589793 / 2))


def write_with_manifest(df: DataFrame, path: str, facts: dict[str, str], required: tuple[str, ...] = ("source", "crs", "time_zone")) -> None:
    """Write Parquet to a new path, and its provenance beside it; refuses to overwrite or to leave out a required fact."""
    lack = [k for k in required if not facts.get(k)]
    if lack:
        raise ValueError(f"missing provenance: {lack}")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    rows = [*facts.items(), ("columns", ",".join(df.columns))]
    df.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("errorifexists").json(f"{path}.manifest")


def write_new_days(df: DataFrame, path: str, day: str, spark: SparkSession, built: DataFrame | None = None) -> DataFrame:
    """Append the days that aren't in the built table yet, partitioned by day; returns those days."""
    days = df.select(day).distinct()
    fresh = days if built is None else days.join(built.select(day).distinct(), day, "left_anti")
    fresh = spark.createDataFrame(fresh.collect(), fresh.schema)  # a row per calendar day; fixed before the table changes
    df.join(F.broadcast(fresh), day, "left_semi").write.mode("append").partitionBy(day).option("compression", "zstd").parquet(path)
    return fresh


def track_features(df: DataFrame, most: int | None = None) -> DataFrame:
    """A GeoJSON feature per track, as text: a point or a line in order of time, of the first ``most`` ids if given."""
    ok = df.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    g = ok.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "longitude", "latitude"))).alias("p"), F.min("base_date_time").alias("t0"), F.max("base_date_time").alias("t1"))
    if most is not None:
        g = g.orderBy("track_id").limit(most)
    place = F.transform("p", lambda x: F.array(x["longitude"], x["latitude"]))
    when = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(n) for c, n in (("t0", "start"), ("t1", "end"))]
    props = F.struct("track_id", F.size("p").alias("n"), *when)
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("LineString").alias("type"), place.alias("coordinates")).alias("geometry")))
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Point").alias("type"), place[0].alias("coordinates")).alias("geometry")))
    return g.select("track_id", F.when(F.size("p") > 1, line).otherwise(point).alias("feature"))


def profile(df: DataFrame) -> DataFrame:
    """One row: reports, vessels, and extent in space and time."""
    return df.agg(F.count("*").alias("reports"), F.count_distinct("track_id").alias("vessels"), F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("t").alias("first"), F.max("t").alias("last"))
