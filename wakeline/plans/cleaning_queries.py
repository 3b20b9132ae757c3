"""Queries for reading, validating and labelling reports, and for small sets, scores and totals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo, identity
from wakeline.operators import joins as J
from wakeline.operators import ranges
from wakeline.plans.registry import haversine, query
from wakeline.sources import archives as A
from wakeline.sources.fixes import fixes, seconds, table, zones

KEY = b"wakeline"
PAD = KEY.ljust(64, b"\0")
INNER, OUTER = (bytes(x ^ y for x in PAD).hex() for y in (0x36, 0x5C))


def _chosen(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    "IO1_canonical_columns",
    """SELECT track_id AS vessel_id, count(*) AS n, sum(CASE WHEN event_id % 7 = 0 OR sog IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_sog,
    round(sum(longitude), 5) AS lon_sum, sum(floor(t))::BIGINT AS t_sum FROM fixes GROUP BY track_id""",
)
def canonical_columns(spark, sf_dir):
    """Padded ids, times as text and speeds that aren't always numbers, by an explicit mapping."""
    raw = fixes(spark, sf_dir).select(
        F.concat(F.lit(" "), "track_id", F.lit("  ")).alias("MMSI"),
        F.date_format("base_date_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("when"),
        F.col("longitude").alias("x"),
        F.col("latitude").cast("string").alias("y"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("sog").cast("string")).alias("SOG"),
    )
    out = A.select_mapped(raw, {"vessel_id": "MMSI", "base_date_time": "when", "longitude": "x", "latitude": "y", "sog": "SOG"})
    total = F.sum(F.floor(seconds(F.col("base_date_time"))))
    return out.groupBy("vessel_id").agg(F.count("*").alias("n"), F.count("sog").alias("n_sog"), F.round(F.sum("longitude"), 5).alias("lon_sum"), total.alias("t_sum"))


@query(
    "IO6_alias_columns",
    "SELECT track_id AS vessel_id, count(*) AS n, round(sum(latitude), 5) AS lat_sum, sum(floor(t))::BIGINT AS t_sum FROM fixes GROUP BY track_id",
)
def alias_columns(spark, sf_dir):
    """Columns found by their usual names; times in seconds or milliseconds."""
    t = F.floor("t")
    raw = fixes(spark, sf_dir).select(
        F.col("track_id").alias("vesselId"), F.when(F.col("event_id") % 2 == 0, t * 1000).otherwise(t).alias("timestamp"), F.col("longitude").alias("LON"), F.col("latitude").alias("lat")
    )
    out = A.select_by_alias(raw)
    total = F.sum(F.floor(seconds(F.col("base_date_time"))))
    return out.groupBy("vessel_id").agg(F.count("*").alias("n"), F.round(F.sum("latitude"), 5).alias("lat_sum"), total.alias("t_sum"))


@query("IO3_reprojected", "SELECT event_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM fixes")
def reprojected(spark, sf_dir):
    """Web Mercator metres back to degrees."""
    r = 6_378_137.0
    x, y = F.radians("longitude") * r, F.log(F.tan(F.lit(0.7853981633974483) + F.radians("latitude") / 2)) * r
    lon, lat = A.from_web_mercator(F.col("x"), F.col("y"))
    out = fixes(spark, sf_dir).select("event_id", x.alias("x"), y.alias("y"))
    return out.select("event_id", F.round(lon, 6).alias("longitude"), F.round(lat, 6).alias("latitude"))


@query("F1_mixed_timestamps", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE floor(t)::BIGINT END AS t FROM fixes")
def mixed_timestamps(spark, sf_dir):
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "'on' d MMMM")
    k, text = F.col("event_id") % 4, F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(k == i, F.date_format("base_date_time", form)).otherwise(text)
    return fixes(spark, sf_dir).select("event_id", F.floor(seconds(A.parse_utc(text))).alias("t"))


@query(
    "F2_one_day_tracks",
    "SELECT track_id, vessel_type, count(*) AS n, strftime(min(base_date_time), '%Y-%m-%d') = strftime(max(base_date_time), '%Y-%m-%d') AS one_day FROM fixes WHERE status = 3 GROUP BY track_id, vessel_type",
)
def one_day_tracks(spark, sf_dir):
    """Whether all times of a group lie in one UTC day."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    same = day(F.min("base_date_time")) == day(F.max("base_date_time"))
    return fixes(spark, sf_dir).where("status = 3").groupBy("track_id", "vessel_type").agg(F.count("*").alias("n"), same.alias("one_day"))


@query("F3_valid_coordinates", "SELECT event_id, coalesce((longitude - 118) * 60 BETWEEN -180 AND 180 AND (latitude - 20) * 20 BETWEEN -90 AND 90, false) AS valid FROM fixes")
def valid_coordinates(spark, sf_dir):
    """Coordinates stretched so that some fall off the globe."""
    return fixes(spark, sf_dir).select("event_id", geo.valid_coordinate((F.col("longitude") - 118) * 60, (F.col("latitude") - 20) * 20).alias("valid"))


@query("F4_bounding_box", "SELECT track_id, sum(CASE WHEN longitude BETWEEN 119 AND 121 AND latitude BETWEEN 22 AND 24 THEN 1 ELSE 0 END)::BIGINT AS inside, count(*) AS n FROM fixes GROUP BY track_id")
def bounding_box(spark, sf_dir):
    inside = geo.in_box(F.col("longitude"), F.col("latitude"), (119.0, 22.0, 121.0, 24.0))
    return fixes(spark, sf_dir).groupBy("track_id").agg(F.count_if(inside).alias("inside"), F.count("*").alias("n"))


@query(
    "F7_keyed_id",
    f"""WITH v AS (SELECT DISTINCT track_id FROM fixes), i AS (SELECT track_id, sha256(unhex('{INNER}') || encode(track_id)) AS h FROM v),
    o AS (SELECT track_id, sha256(unhex('{OUTER}') || unhex(h)) AS h FROM i)
    SELECT track_id, 'v_' || translate(to_base64(unhex(substr(h, 1, 36))), '+/', '-_') AS opaque FROM o""",
)
def keyed_id(spark, sf_dir):
    return fixes(spark, sf_dir).select("track_id").distinct().select("track_id", identity.keyed_id(F.col("track_id"), KEY).alias("opaque"))


@query(
    "F8_contract_errors",
    """SELECT count(*) AS n, sum(CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END)::BIGINT AS no_id, sum(CASE WHEN NOT (longitude * 1.5 <= 180) THEN 1 ELSE 0 END)::BIGINT AS bad_place,
    sum(CASE WHEN sog - 5 < 0 THEN 1 ELSE 0 END)::BIGINT AS bad_sog, sum(CASE WHEN cog + 90 >= 360 THEN 1 ELSE 0 END)::BIGINT AS bad_cog FROM fixes""",
)
def contract_errors(spark, sf_dir):
    """How many reports break each rule of the public columns, counted before anything is raised."""
    df = fixes(spark, sf_dir).select(
        F.when(F.col("event_id") % 13 != 0, F.col("track_id")).alias("track_id"), (F.col("longitude") * 1.5).alias("longitude"), "latitude", (F.col("sog") - 5).alias("sog"), (F.col("cog") + 90).alias("cog")
    )
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("track_id").isNull()).alias("no_id"),
        F.count_if(~geo.valid_coordinate(F.col("longitude"), F.col("latitude"))).alias("bad_place"),
        F.count_if(F.col("sog") < 0).alias("bad_sog"),
        F.count_if((F.col("cog") < 0) | (F.col("cog") >= 360)).alias("bad_cog"),
    )


@query(
    "F11_archive_sentinels",
    """SELECT track_id, count(*) AS n, sum(CASE WHEN sog * 6 < 102.3 THEN 1 ELSE 0 END)::BIGINT AS n_sog, sum(CASE WHEN cog + 30 < 360 THEN 1 ELSE 0 END)::BIGINT AS n_cog
    FROM fixes WHERE event_id % 11 <> 0 GROUP BY track_id""",
)
def archive_sentinels(spark, sf_dir):
    zero = F.col("event_id") % 11 == 0
    df = fixes(spark, sf_dir).withColumns(
        {"sog": F.col("sog") * 6, "cog": F.col("cog") + 30, "latitude": F.when(zero, 0.0).otherwise(F.col("latitude")), "longitude": F.when(zero, 0.0).otherwise(F.col("longitude"))}
    )
    return A.sentinels_to_null(df).groupBy("track_id").agg(F.count("*").alias("n"), F.count("sog").alias("n_sog"), F.count("cog").alias("n_cog"))


@query(
    "F12_live_sentinels",
    """WITH m AS (SELECT CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 18 ELSE 27 END AS kind, event_id % 5 = 0 AS lost, sog, cog, heading FROM fixes),
    v AS (SELECT kind, CASE WHEN lost THEN CASE kind WHEN 27 THEN 63 ELSE 102.3 END ELSE sog END AS s, CASE WHEN lost THEN CASE kind WHEN 27 THEN 511 ELSE 360 END ELSE cog END AS c,
      CASE WHEN lost THEN 511 ELSE heading END AS h FROM m)
    SELECT kind::BIGINT AS kind, sum(CASE WHEN s < CASE kind WHEN 27 THEN 63 ELSE 102.3 END THEN 1 ELSE 0 END)::BIGINT AS n_sog,
      sum(CASE WHEN c < CASE kind WHEN 27 THEN 511 ELSE 360 END THEN 1 ELSE 0 END)::BIGINT AS n_cog, sum(CASE WHEN h < 511 THEN 1 ELSE 0 END)::BIGINT AS n_heading FROM v GROUP BY kind""",
)
def live_sentinels(spark, sf_dir):
    kind, lost = _chosen(F.col("event_id") % 4, (1, 3, 18, 27)), F.col("event_id") % 5 == 0
    far = F.col("kind") == 27
    df = fixes(spark, sf_dir).withColumn("kind", kind).select(
        "kind",
        F.when(lost, F.when(far, 63.0).otherwise(102.3)).otherwise(F.col("sog")).alias("sog"),
        F.when(lost, F.when(far, 511.0).otherwise(360.0)).otherwise(F.col("cog")).alias("cog"),
        F.when(lost, 511.0).otherwise(F.col("heading")).alias("heading"),
    )
    s, c, h = identity.live_kinematics(F.col("kind"), F.col("sog"), F.col("cog"), F.col("heading"))
    return df.groupBy(F.col("kind").cast("long").alias("kind")).agg(F.count(s).alias("n_sog"), F.count(c).alias("n_cog"), F.count(h).alias("n_heading"))


CLASSES = ("FISHING", " cargo", "Passenger", "CARRIER", "BUNKER", "SEISMIC_VESSEL", "OTHER", "NA", "RAFT")
STATUSES = (*identity.NAV_STATUS, "UNKNOWN")


@query(
    "F14_feed_classes",
    f"""WITH k AS (SELECT trim(upper(({_list(CLASSES)})[(event_id % 9 + 1)::INT])) AS class FROM fixes)
    SELECT CASE class WHEN 'FISHING' THEN 'fishing' WHEN 'CARGO' THEN 'cargo' WHEN 'PASSENGER' THEN 'passenger' WHEN 'CARRIER' THEN 'carrier' WHEN 'BUNKER' THEN 'bunker'
      WHEN 'SEISMIC_VESSEL' THEN 'seismic' WHEN 'OTHER' THEN 'other' WHEN 'NA' THEN 'other' END AS category, count(*) AS n FROM k GROUP BY 1""",
)
def feed_classes(spark, sf_dir):
    category = identity.looked_up(_chosen(F.col("event_id") % 9, CLASSES), identity.FEED_CLASSES)
    return fixes(spark, sf_dir).groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@query(
    "F15_status_codes",
    f"SELECT event_id, CASE WHEN event_id % 10 < 9 THEN event_id % 10 END AS code FROM fixes WHERE ({_list(STATUSES)})[(event_id % 10 + 1)::INT] IS NOT NULL",
)
def status_codes(spark, sf_dir):
    code = identity.looked_up(_chosen(F.col("event_id") % 10, STATUSES), identity.NAV_STATUS)
    return fixes(spark, sf_dir).select("event_id", code.cast("long").alias("code"))


NAMES_SQL = """n AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'mjy' || c_custkey || '-15-57%' WHEN 1 THEN 'CT' || c_custkey || '-71' WHEN 2 THEN 'AAAAAA' WHEN 3 THEN c_name
  WHEN 4 THEN 'Minlianyu' || c_custkey + 100 WHEN 5 THEN 'FV Star ' || c_custkey WHEN 6 THEN c_custkey + 100000 || '' END AS name, (c_custkey + 100000) || '' AS mmsi,
  (['cargo', 'ferry', 'tanker', 'tug', 'other'])[(c_custkey % 5 + 1)::INT] AS ship_type FROM customer)"""


def _names(spark, sf_dir):
    k = F.col("c_custkey")
    text = k.cast("string")
    name = _chosen  # names of buoys, boats and others, made from the customers' keys
    kinds = [F.concat(F.lit("mjy"), text, F.lit("-15-57%")), F.concat(F.lit("CT"), text, F.lit("-71")), F.lit("AAAAAA"), F.col("c_name"), F.concat(F.lit("Minlianyu"), (k + 100).cast("string"))]
    kinds += [F.concat(F.lit("FV Star "), text), (k + 100000).cast("string"), F.lit(None).cast("string")]
    return table(spark, sf_dir, "customer").select(
        k, F.element_at(F.array(*kinds), (k % 8 + 1).cast("int")).alias("name"), (k + 100000).cast("string").alias("mmsi"), name(k % 5, ("cargo", "ferry", "tanker", "tug", "other")).alias("ship_type")
    )


@query(
    "F17_gear_names",
    "WITH " + NAMES_SQL + r""", u AS (SELECT *, upper(trim(coalesce(name, ''))) AS x FROM n) SELECT c_custkey, x <> '' AND x <> mmsi AND
    (regexp_matches(x, '%|^[A-Z]{1,4}\d*-+\d|-{2,}|^[^A-Z0-9]{3,}$|^\W*[0-9 ]{5,}\W*$') OR (length(x) >= 6 AND replace(x, substr(x, 1, 1), '') = '')) AS gear FROM u""",
)
def gear_names(spark, sf_dir):
    return _names(spark, sf_dir).select("c_custkey", identity.looks_like_gear(F.col("name"), F.col("mmsi")).alias("gear"))


@query(
    "F18_exempt_vessels",
    "WITH " + NAMES_SQL + r""" SELECT c_custkey, ship_type IN ('ferry', 'tug') OR
    regexp_matches(replace(upper(coalesce(name, '')), '-', ''), '[A-Z]{2,}YU\s?\d{2,}|\bFV\b|FISHING|TRAWL|\bYU\s?\d{3,}|NO\.?\s?\d+$') AS exempt FROM n""",
)
def exempt_vessels(spark, sf_dir):
    return _names(spark, sf_dir).select("c_custkey", identity.is_exempt(F.col("ship_type"), F.col("name")).alias("exempt"))


@query(
    "F21_as_of_cut",
    "WITH m AS (SELECT min(t) + (max(t) - min(t)) / 3 AS cut FROM fixes) SELECT track_id, count(*) AS n, max(event_id) FILTER (WHERE t <= cut) AS newest FROM fixes, m WHERE t <= cut GROUP BY track_id",
)
def as_of_cut(spark, sf_dir):
    """What is known after a third of the time: later reports are ignored."""
    df = fixes(spark, sf_dir)
    cut = df.agg((F.min("t") + (F.max("t") - F.min("t")) / 3).alias("cut"))  # one row
    return df.crossJoin(F.broadcast(cut)).where("t <= cut").groupBy("track_id").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query(
    "F24_all_eligible",
    """WITH v AS (SELECT user_id, count(*) >= 70 AS ok FROM fixes GROUP BY user_id), e AS (SELECT o_orderkey, o_custkey % 150 AS a, (o_custkey * 7) % 150 AS b FROM orders)
    SELECT o_orderkey FROM e LEFT JOIN v x ON x.user_id = a LEFT JOIN v y ON y.user_id = b WHERE coalesce(x.ok, true) AND coalesce(y.ok, true)""",
)
def all_eligible(spark, sf_dir):
    """Events all of whose known vessels are eligible; unknown ones don't count against it."""
    known = fixes(spark, sf_dir).groupBy("user_id").agg((F.count("*") >= 70).alias("ok"))
    vessels = F.array(F.col("o_custkey") % 150, F.col("o_custkey") * 7 % 150)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(vessels).alias("user_id")).join(known, "user_id", "left")
    return rows.groupBy("o_orderkey").agg(F.bool_and(F.coalesce("ok", F.lit(True))).alias("ok")).where("ok").select("o_orderkey")


@query("SO1_stable_order", "SELECT event_id, row_number() OVER (PARTITION BY track_id ORDER BY floor(t / 86400), (event_id * 31) % 1009, event_id) AS place FROM fixes")
def stable_order(spark, sf_dir):
    """Order by id and time (whole days, so that times tie), ties in order of arrival."""
    w = W.partitionBy("track_id").orderBy(F.floor(F.col("t") / 86400), F.col("event_id") * 31 % 1009, "event_id")
    return fixes(spark, sf_dir).select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query(
    "SO2_review_budgets",
    """WITH r AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT unnest([10, 20, 50])::BIGINT AS budget)
    SELECT budget, count(*) AS n, round(min(p_retailprice), 4) AS lowest FROM b JOIN r ON r.r <= budget GROUP BY budget""",
)
def review_budgets(spark, sf_dir):
    """The first 10, 20 and 50 by price: one bounded sort, then counts over the rows that any budget takes."""
    top = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    top = top.withColumn("r", F.row_number().over(W.orderBy(F.desc("p_retailprice"), "p_partkey")))  # 50 rows
    taken = top.withColumn("budget", F.explode(F.filter(F.array(F.lit(10), F.lit(20), F.lit(50)), lambda b: b >= F.col("r"))))
    taken = taken.withColumn("budget", F.col("budget").cast("long"))
    return taken.groupBy("budget").agg(F.count("*").alias("n"), F.round(F.min("p_retailprice"), 4).alias("lowest"))


@query("SO9_top_by_risk", "SELECT o_orderkey, round(o_totalprice, 4) AS risk FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 70")
def top_by_risk(spark, sf_dir):
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(70)
    return top.select("o_orderkey", F.round("o_totalprice", 4).alias("risk"))


@query(
    "SO4_strongest_deviations",
    """WITH p AS (SELECT track_id, unnest(['sog', 'cog', 'heading', 'n']) AS feature, unnest([avg(sog), avg(cog), avg(heading), count(*)::DOUBLE]) AS v FROM fixes GROUP BY track_id),
    m AS (SELECT feature, median(v) AS med FROM p GROUP BY feature), d AS (SELECT feature, median(abs(v - med)) AS mad FROM p JOIN m USING (feature) GROUP BY feature),
    z AS (SELECT track_id, feature, round((v - med) / mad, 6) AS z FROM p JOIN m USING (feature) JOIN d USING (feature)),
    r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY abs(z) DESC, feature) AS r FROM z) SELECT track_id, feature, z FROM r WHERE r <= 3 AND abs(z) >= 1.5""",
)
def strongest_deviations(spark, sf_dir):
    """The three strongest deviations of each vessel from the fleet, of these the marked ones; the cut comes first."""
    wide = fixes(spark, sf_dir).groupBy("track_id").agg(*[F.avg(c).alias(c) for c in ("sog", "cog", "heading")], F.count("*").cast("double").alias("n"))
    long = wide.unpivot(["track_id"], ["sog", "cog", "heading", "n"], "feature", "v")
    med = ranges.percentiles(long, ["feature"], "v", {"med": 0.5})  # a row per feature
    dev = long.join(F.broadcast(med), "feature")
    mad = ranges.percentiles(dev.withColumn("off", F.abs(F.col("v") - F.col("med"))), ["feature"], "off", {"mad": 0.5})
    z = dev.join(F.broadcast(mad), "feature").withColumn("z", F.round((F.col("v") - F.col("med")) / F.col("mad"), 6))
    first = W.partitionBy("track_id").orderBy(F.desc(F.abs("z")), "feature")
    return z.withColumn("r", F.row_number().over(first)).where("r <= 3 and abs(z) >= 1.5").select("track_id", "feature", "z")


@query("SE1_union_of_days", "SELECT status, count(*) AS n, sum(CASE WHEN event_id % 2 = 0 AND sog IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_sog FROM fixes GROUP BY status")
def union_of_days(spark, sf_dir):
    """Files by name of column; what one of them lacks is null."""
    df = fixes(spark, sf_dir)
    a, b = df.where("event_id % 2 = 0").select("status", "sog"), df.where("event_id % 2 = 1").select("status")
    return a.unionByName(b, allowMissingColumns=True).groupBy("status").agg(F.count("*").alias("n"), F.count("sog").alias("n_sog"))


@query(
    "SE3_set_checks",
    """WITH s AS (SELECT track_id, list_sort(list(DISTINCT status)) AS seen FROM fixes WHERE event_id % 10 = 0 GROUP BY track_id)
    SELECT track_id, len(list_filter(seen, lambda x: x NOT IN (0, 1, 2, 3, 4, 5)))::BIGINT AS n_other, len(list_filter(seen, lambda x: x NOT IN (0, 1, 2, 3, 4, 5, 6, 7))) = 0 AS subset FROM s""",
)
def set_checks(spark, sf_dir):
    seen = fixes(spark, sf_dir).where("event_id % 10 = 0").groupBy("track_id").agg(F.collect_set(F.col("status").cast("int")).alias("seen"))  # nine statuses
    few, most = F.array(*[F.lit(k) for k in range(6)]), F.array(*[F.lit(k) for k in range(8)])
    return seen.select("track_id", F.size(F.array_except("seen", few)).cast("long").alias("n_other"), (F.size(F.array_except("seen", most)) == 0).alias("subset"))


@query(
    "SE5_alert_details",
    """SELECT strftime(base_date_time, '%Y-%m-%d') || '__speed__' || track_id || '__' || event_id AS alert_id, track_id, 2::BIGINT AS n_reasons, round(coalesce(sog, 0) + status, 4) AS total FROM fixes WHERE event_id % 9 = 0""",
)
def alert_details(spark, sf_dir):
    """Composite ids, taken apart again, and reasons kept as JSON text."""
    reasons = F.to_json(F.array(F.struct(F.lit("speed").alias("code"), F.coalesce("sog", F.lit(0.0)).alias("value")), F.struct(F.lit("status").alias("code"), F.col("status").cast("double").alias("value"))))
    ident = F.concat_ws("__", F.date_format("base_date_time", "yyyy-MM-dd"), F.lit("speed"), "track_id", F.col("event_id").cast("string"))
    df = fixes(spark, sf_dir).where("event_id % 9 = 0").select(ident.alias("alert_id"), reasons.alias("reasons"))
    df = df.withColumn("r", F.from_json("reasons", "array<struct<code:string,value:double>>"))
    total = F.aggregate("r", F.lit(0.0), lambda s, x: s + x["value"])
    return df.select("alert_id", F.split("alert_id", "__")[2].alias("track_id"), F.size("r").cast("long").alias("n_reasons"), F.round(total, 4).alias("total"))


LEGS = "g AS (SELECT *, lag(latitude) OVER p AS pla, lag(longitude) OVER p AS plo FROM fixes WINDOW p AS (PARTITION BY track_id ORDER BY t, event_id))"


@query(
    "SC4_path_metrics",
    "WITH " + LEGS + ", m AS (SELECT track_id, sum(coalesce(" + haversine("pla", "plo", "latitude", "longitude") + ", 0)) AS path, arg_min(latitude, (t, event_id)) AS a, arg_min(longitude, (t, event_id)) AS b,"
    " arg_max(latitude, (t, event_id)) AS c, arg_max(longitude, (t, event_id)) AS d FROM g GROUP BY track_id), s AS (SELECT track_id, path, " + haversine("a", "b", "c", "d") + " AS shift FROM m)"
    " SELECT track_id, round(path, 3) AS path_m, round(shift, 3) AS displacement_m, CASE WHEN shift >= 50 THEN round(path / shift, 4) END AS ratio FROM s",
)
def path_metrics(spark, sf_dir):
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    df = fixes(spark, sf_dir).withColumns({"pla": F.lag("latitude").over(w), "plo": F.lag("longitude").over(w)})
    leg = geo.haversine_m(F.col("pla"), F.col("plo"), F.col("latitude"), F.col("longitude"))
    ends = F.struct("t", "event_id", "latitude", "longitude")
    g = df.groupBy("track_id").agg(F.sum(F.coalesce(leg, F.lit(0.0))).alias("path"), F.min(ends).alias("a"), F.max(ends).alias("z"))
    g = g.withColumn("shift", geo.haversine_m(F.col("a.latitude"), F.col("a.longitude"), F.col("z.latitude"), F.col("z.longitude")))
    ratio = F.when(F.col("shift") >= 50, F.round(F.col("path") / F.col("shift"), 4))
    return g.select("track_id", F.round("path", 3).alias("path_m"), F.round("shift", 3).alias("displacement_m"), ratio.alias("ratio"))


@query(
    "SC7_centroids_and_circles",
    "SELECT zone_id, round(lat_c, 6) AS lat, round(lon_c, 6) AS lon, round(lat_c + degrees(9260 / 6371008.8e0), 6) AS north, 36::BIGINT AS n FROM zones",
)
def centroids_and_circles(spark, sf_dir):
    """The mean of a ring's corners, and a ring of 36 points five nautical miles around it."""
    n = F.size("ring")
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[c]) / n
    df = zones(spark, sf_dir).select("zone_id", mean("lat").alias("lat"), mean("lon").alias("lon"))
    circle = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda k: geo.destination(F.col("lat"), F.col("lon"), k * 10.0, F.lit(9260.0))[0])
    df = df.withColumn("circle", circle)
    return df.select("zone_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round(F.array_max("circle"), 6).alias("north"), F.size("circle").cast("long").alias("n"))


@query("SC8_grid_cells", "SELECT floor(latitude / 0.25e0)::BIGINT AS ci, floor(longitude / 0.25e0)::BIGINT AS cj, count(*) AS n, count(DISTINCT track_id) AS vessels FROM fixes GROUP BY 1, 2")
def grid_cells(spark, sf_dir):
    ci, cj = geo.cell(F.col("latitude"), 0.25).cast("long"), geo.cell(F.col("longitude"), 0.25).cast("long")
    return fixes(spark, sf_dir).groupBy(ci.alias("ci"), cj.alias("cj")).agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("vessels"))


@query("SC10_percentiles", "SELECT track_id, round(quantile_cont(sog, 0.1), 6) AS p10, round(quantile_cont(sog, 0.5), 6) AS p50, round(quantile_cont(sog, 0.95), 6) AS p95 FROM fixes GROUP BY track_id")
def percentiles(spark, sf_dir):
    q = lambda p: F.round(F.percentile("sog", p), 6)
    return fixes(spark, sf_dir).groupBy("track_id").agg(q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.95).alias("p95"))


@query(
    "SC14_clipped_scale",
    """WITH v AS (SELECT track_id, event_id, sog FROM fixes WHERE sog IS NOT NULL), p AS (SELECT track_id, quantile_cont(sog, 0.01) AS lo, quantile_cont(sog, 0.99) AS hi, median(sog) AS med,
    (quantile_cont(sog, 0.75) - quantile_cont(sog, 0.25)) / 1.349 AS s FROM v GROUP BY track_id)
    SELECT event_id, round(CASE WHEN s > 0 THEN (greatest(lo, least(hi, sog)) - med) / s ELSE 0 END, 4) AS scaled FROM v JOIN p USING (track_id)""",
)
def clipped_scale(spark, sf_dir):
    """Each report's speed against its vessel's own profile: clipped to the profile's range, then scaled by its quartiles.

    The fourth digit is rounded in binary, as SQL does: Spark's round of so many digits goes by the shortest decimal, and tells ties otherwise.
    """
    v = fixes(spark, sf_dir).where("sog is not null")
    profile = ranges.percentiles(v, ["track_id"], "sog", {"lo": 0.01, "hi": 0.99, "med": 0.5, "q1": 0.25, "q3": 0.75}, as_sql=True)
    profile = profile.withColumn("s", (F.col("q3") - F.col("q1")) / 1.349)
    scaled = F.when(F.col("s") > 0, (F.greatest("lo", F.least("hi", "sog")) - F.col("med")) / F.col("s")).otherwise(0.0)
    return v.join(profile, "track_id").select("event_id", (F.round(scaled * 1e4) / 1e4).alias("scaled"))


@query(
    "SC18_evidence_messages",
    """WITH p AS (SELECT p_partkey, (rank() OVER (ORDER BY p_size) - 1) * 1.0e0 / count(*) OVER () AS p FROM part)
    SELECT p_partkey, CASE WHEN p >= 0.5 THEN format('Size is at permille {} of the background.', floor(p * 1000)::BIGINT) ELSE format('Size is below {} permille of the background.', floor(1000 - p * 1000)::BIGINT) END AS message FROM p""",
)
def evidence_messages(spark, sf_dir):
    """Sentences from percentiles; sizes are counted first, so the running count is over fifty values."""
    part = table(spark, sf_dir, "part")
    sizes = part.groupBy("p_size").agg(F.count("*").alias("n"))
    upto = W.orderBy("p_size").rowsBetween(W.unboundedPreceding, -1)  # a row per size
    sizes = sizes.select("p_size", (F.coalesce(F.sum("n").over(upto), F.lit(0)) / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("p"))
    high = F.format_string("Size is at permille %d of the background.", F.floor(F.col("p") * 1000))
    low = F.format_string("Size is below %d permille of the background.", F.floor(1000 - F.col("p") * 1000))
    return part.join(F.broadcast(sizes), "p_size").select("p_partkey", F.when(F.col("p") >= 0.5, high).otherwise(low).alias("message"))


@query(
    "SC20_second_reading",
    "SELECT event_id, round(least(0.99e0, greatest(0.05e0, (status + 1) / 10.0e0 + CASE WHEN (coalesce(sog, 0) < 10) = (event_id % 3 = 0) THEN 0.1e0 ELSE -0.15e0 END)), 2) AS confidence FROM fixes",
)
def second_reading(spark, sf_dir):
    """Confidence goes up where a second reading agrees, and down where it doesn't."""
    agrees = (F.coalesce("sog", F.lit(0.0)) < 10) == (F.col("event_id") % 3 == 0)
    c = (F.col("status") + 1) / 10.0 + F.when(agrees, 0.1).otherwise(-0.15)
    return fixes(spark, sf_dir).select("event_id", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), c)), 2).alias("confidence"))


@query(
    "SC21_freshness",
    "WITH m AS (SELECT max(t) AS now FROM fixes), l AS (SELECT track_id, max(t) AS t FROM fixes GROUP BY track_id) SELECT track_id, round(now - t, 1) AS age_s, CASE WHEN now - t < 43200 THEN 'fresh' ELSE 'stale' END AS state FROM l, m",
)
def freshness(spark, sf_dir):
    last = fixes(spark, sf_dir).groupBy("track_id").agg(F.max("t").alias("t"))
    now = last.agg(F.max("t").alias("now"))  # one row
    age = F.col("now") - F.col("t")
    return last.crossJoin(F.broadcast(now)).select("track_id", F.round(age, 1).alias("age_s"), F.when(age < 43_200, "fresh").otherwise("stale").alias("state"))


@query(
    "J1_reports_in_spans",
    """SELECT s.event_id, count(*) AS n FROM fixes s JOIN fixes p ON p.user_id = s.user_id AND p.t BETWEEN s.t AND s.t + 43200 AND p.event_id % 5 <> 0 WHERE s.event_id % 5 = 0 GROUP BY s.event_id""",
)
def reports_in_spans(spark, sf_dir):
    df = fixes(spark, sf_dir)
    spans = df.where("event_id % 5 = 0").select("user_id", "event_id", F.col("t").alias("lo"), (F.col("t") + 43_200).alias("hi"))
    points = df.where("event_id % 5 <> 0").select("user_id", "t")
    return J.range_bucket_join(points, spans, ["user_id"], "t", "lo", "hi", 43_200.0).groupBy("event_id").agg(F.count("*").alias("n"))


@query(
    "J14_bracketed_positions",
    """WITH f AS (SELECT track_id, t, max(latitude) AS latitude FROM fixes GROUP BY track_id, t), g AS (SELECT DISTINCT track_id, floor(t / 86400) * 86400 + 43200 AS t FROM fixes),
    a AS (SELECT g.track_id, g.t, f.t AS t0, f.latitude AS y0 FROM g ASOF LEFT JOIN f ON g.track_id = f.track_id AND g.t >= f.t),
    b AS (SELECT a.*, f.t AS t1, f.latitude AS y1 FROM a ASOF LEFT JOIN f ON a.track_id = f.track_id AND a.t <= f.t)
    SELECT track_id, t::BIGINT AS t, round(CASE WHEN least(t - t0 + 0 * t1, t1 - t + 0 * t0) <= 21600 THEN y0 + CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END * (y1 - y0) END, 5) AS latitude FROM b""",
)
def bracketed_positions(spark, sf_dir):
    """Each vessel's latitude at noon of its days, between the reports around, if one of them is within six hours."""
    df = fixes(spark, sf_dir).select("track_id", "t", "latitude")
    grid = df.select("track_id", (F.floor(F.col("t") / 86400) * 86400.0 + 43200).alias("t")).distinct()
    out = J.interpolate(grid, df, ["track_id"], "t", ["latitude"], 21_600.0)
    return out.select("track_id", F.col("t").cast("long").alias("t"), F.round("latitude", 5).alias("latitude"))


@query(
    "J20_best_window_score",
    """WITH a AS (SELECT event_id AS alert, user_id, t AS a0, t + 7200 AS a1 FROM fixes WHERE event_id % 6 = 0), w AS (SELECT event_id, user_id, t AS w0, t + 14400 AS w1, event_id % 97 AS score FROM fixes WHERE event_id % 6 <> 0)
    SELECT alert, max(score) AS best, count(*) AS n FROM a JOIN w ON a.user_id = w.user_id AND a0 - 3600 <= w1 AND a1 + 3600 >= w0 GROUP BY alert""",
)
def best_window_score(spark, sf_dir):
    """The best score of the windows that overlap an alert, an hour's slack at both ends."""
    df = fixes(spark, sf_dir)
    alerts = df.where("event_id % 6 = 0").select(F.col("event_id").alias("alert"), "user_id", F.col("t").alias("a0"), (F.col("t") + 7200).alias("a1"))
    scored = df.where("event_id % 6 <> 0").select("user_id", F.col("t").alias("w0"), (F.col("t") + 14_400).alias("w1"), (F.col("event_id") % 97).alias("score"))
    met = J.overlap_join(alerts, scored, ["user_id"], ("a0", "a1"), ("w0", "w1"), 14_400.0, 3600.0)
    return met.groupBy("alert").agg(F.max("score").alias("best"), F.count("*").alias("n"))


@query(
    "AG17_typical_interval",
    """WITH d AS (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t, event_id) - t AS dt FROM fixes), g AS (SELECT track_id, count(*) AS n, count(dt) FILTER (WHERE latitude >= 23) AS c,
    median(dt) FILTER (WHERE latitude >= 23) AS near, median(dt) AS every FROM d GROUP BY track_id)
    SELECT track_id, round(CASE WHEN n < 3 THEN 600 WHEN c >= 3 THEN near ELSE every END, 3) AS interval_s FROM g""",
)
def typical_interval(spark, sf_dir):
    """The median interval of a vessel's reports, of those in coverage (north of 23 degrees) where there are enough."""
    dt = F.lead("t").over(W.partitionBy("track_id").orderBy("t", "event_id")) - F.col("t")
    near = F.when(F.col("latitude") >= 23, F.col("dt"))
    g = fixes(spark, sf_dir).withColumn("dt", dt).groupBy("track_id")
    g = g.agg(F.count("*").alias("n"), F.count(near).alias("c"), F.percentile(near, 0.5).alias("near"), F.percentile("dt", 0.5).alias("every"))
    return g.select("track_id", F.round(F.when(F.col("n") < 3, 600.0).when(F.col("c") >= 3, F.col("near")).otherwise(F.col("every")), 3).alias("interval_s"))


@query(
    "AG44_allocation_totals",
    """SELECT s_nationkey, round(sum(least(l_quantity, 25)), 2)::DOUBLE AS satisfied, round(sum(greatest(l_quantity - 25, 0)), 2)::DOUBLE AS unmet,
    sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS n_unmet FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey""",
)
def allocation_totals(spark, sf_dir):
    """Per port nation, what a limit of 25 a line satisfies and what it leaves."""
    q = F.col("l_quantity").cast("double")
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", q.alias("q")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    got, left = F.least("q", F.lit(25.0)), F.greatest(F.col("q") - 25, F.lit(0.0))
    return df.groupBy("s_nationkey").agg(F.round(F.sum(got), 2).alias("satisfied"), F.round(F.sum(left), 2).alias("unmet"), F.count_if(F.col("q") > 25).alias("n_unmet"))


@query(
    "AG52_hits_by_programme",
    """WITH l AS (SELECT s_suppkey, unnest(string_split('P' || s_nationkey % 3 || ';Q' || s_suppkey % 2, ';')) AS programme FROM supplier WHERE s_acctbal < 0)
    SELECT programme, count(DISTINCT track_id) AS vessels, count(*) AS reports FROM l JOIN fixes ON user_id = s_suppkey GROUP BY programme""",
)
def hits_by_programme(spark, sf_dir):
    """Listed vessels that were seen, by the programmes that list them."""
    text = F.concat(F.lit("P"), (F.col("s_nationkey") % 3).cast("string"), F.lit(";Q"), (F.col("s_suppkey") % 2).cast("string"))
    listed = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"), F.explode(F.split(text, ";")).alias("programme"))
    hits = fixes(spark, sf_dir).select("user_id", "track_id").join(listed, "user_id")
    return hits.groupBy("programme").agg(F.count_distinct("track_id").alias("vessels"), F.count("*").alias("reports"))


@query(
    "AG53_vessel_profile",
    """WITH z AS (SELECT track_id, count(*) AS hits FROM fixes f JOIN zones z ON abs(f.longitude - z.lon_c) <= z.half_deg AND abs(f.latitude - z.lat_c) <= z.half_deg GROUP BY track_id)
    SELECT f.track_id, coalesce(any_value(hits), 0)::BIGINT AS zone_hits, round(count(*) FILTER (WHERE sog BETWEEN 3 AND 8) / count(*), 6) AS share_3_8 FROM fixes f LEFT JOIN z USING (track_id) GROUP BY f.track_id""",
)
def vessel_profile(spark, sf_dir):
    """Reports inside zones, and the share of reports in a speed band, for each vessel."""
    df = fixes(spark, sf_dir)
    hits = J.in_squares(df, zones(spark, sf_dir)).groupBy("track_id").agg(F.count("*").alias("hits"))
    band = df.groupBy("track_id").agg((F.count_if(F.col("sog").between(3, 8)) / F.count("*")).alias("share"))
    return band.join(hits, "track_id", "left").select("track_id", F.coalesce("hits", F.lit(0)).alias("zone_hits"), F.round("share", 6).alias("share_3_8"))
