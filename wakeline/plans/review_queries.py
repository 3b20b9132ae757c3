"""Queries for provider labels, public redaction, habits, gatherings, route distances and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.functions import geo
from wakeline.operators import joins as J
from wakeline.operators import tracks as T
from wakeline.plans.context_queries import TRUTH, truth
from wakeline.plans.registry import haversine, query
from wakeline.sources.fixes import fixes, zones

# Provider words by category, in order of precedence, and codes of ship types.
PROVIDER = (
    ("Research / Survey", "research|survey|oceanographic|scientific"),
    ("Government / Law Enforcement", "law enforcement|coast guard|government|military|naval|patrol"),
    ("Pleasure / Sailing", "pleasure|sailing|yacht"),
    ("Fishing", "fishing|trawler"),
    ("Tanker", "tanker"),
    ("Passenger", "passenger|ferry|cruise"),
    ("Tug / Service", r"tug|towing|pilot|dredg|service|supply|tender|search and rescue|\bsar\b"),
    ("Cargo", "cargo|container|bulk carrier|freighter"),
)
CODES = (
    ("Fishing", [30]),
    ("Tug / Service", [31, 32, 33, 34, 50, 51, 52, 53, 54, 58, 59]),
    ("Government / Law Enforcement", [35, 55]),
    ("Pleasure / Sailing", [36, 37]),
    ("Passenger", list(range(60, 70))),
    ("Cargo", list(range(70, 80))),
    ("Tanker", list(range(80, 90))),
    ("Other", list(range(90, 100))),
)
TEXTS = ("", " Trawler ", "SAR vessel", "Ferry, cruise", "other", "unlisted", "Bulk Carrier", "naval tender")


def provider_category(text):
    """Category by a provider's words, null if none is known."""
    low, out = F.lower(F.trim(text)), None
    for name, words in PROVIDER:
        out = F.when(low.rlike(words), name) if out is None else out.when(low.rlike(words), name)
    return out.when(low == "other", "Other")


def _provider_sql(text):
    low = f"lower(trim({text}))"
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '{w}') THEN '{n}'" for n, w in PROVIDER) + f" WHEN {low} = 'other' THEN 'Other' END"


_TEXT = "[" + ", ".join(f"'{t}'" for t in TEXTS) + "]"
_CODE = "CASE " + " ".join(f"WHEN code IN ({', '.join(map(str, c))}) THEN '{n}'" for n, c in CODES) + " ELSE 'Unknown' END"


@query(
    "F36_provider_category",
    f"""WITH v AS (SELECT DISTINCT track_id, vessel_type - 40 * (user_id % 2) AS code, {_TEXT}[user_id % 8 + 1] AS near, {_TEXT}[user_id // 8 % 8 + 1] AS wide FROM fixes),
    c AS (SELECT *, {_provider_sql('near')} AS a, {_provider_sql('wide')} AS b FROM v)
    SELECT track_id, coalesce(CASE WHEN a <> 'Other' THEN a END, b, {_CODE}) AS category FROM c""",
)
def provider_categories(spark, sf_dir):
    """The specific text wins unless it says other, then the general text, then the code."""
    text = lambda i: F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (i % 8 + 1).cast("int"))
    u = F.col("user_id")
    v = fixes(spark, sf_dir).select("track_id", (F.col("vessel_type") - 40 * (u % 2)).alias("code"), text(u).alias("near"), text(F.floor(u / 8)).alias("wide")).distinct()
    code = F.coalesce(*[F.when(F.col("code").isin(c), n) for n, c in CODES], F.lit("Unknown"))
    near = provider_category(F.col("near"))
    return v.select("track_id", F.coalesce(F.when(near != "Other", near), provider_category(F.col("wide")), code).alias("category"))


@query(
    "F37_integrity_labels",
    """WITH a AS (SELECT event_id, event_id % 13 = 0 AS synthesized, CASE event_id % 5 WHEN 0 THEN 'fresh' WHEN 1 THEN 'stale' WHEN 2 THEN 'unknown' END AS freshness,
    CASE WHEN event_id % 7 > 0 THEN event_id * 37 % 500 END AS age FROM fixes)
    SELECT event_id, CASE WHEN synthesized THEN 'provider_interpolated' WHEN freshness = 'fresh' THEN 'live' WHEN freshness IS NOT NULL THEN freshness
    WHEN age <= 60 THEN 'live' WHEN age <= 300 THEN 'cached' ELSE 'stale' END AS label FROM a""",
)
def integrity_labels(spark, sf_dir):
    """What a report's source says of it: interpolated, else the provider's freshness, else its age in seconds."""
    e = F.col("event_id")
    freshness = F.when(e % 5 == 0, "fresh").when(e % 5 == 1, "stale").when(e % 5 == 2, "unknown")
    age = F.when(e % 7 > 0, e * 37 % 500)
    by_age = F.when(age <= 60, "live").when(age <= 300, "cached").otherwise("stale")
    label = F.when(e % 13 == 0, "provider_interpolated").when(freshness == "fresh", "live").otherwise(F.coalesce(freshness, by_age))
    return fixes(spark, sf_dir).select("event_id", label.alias("label"))


@query(
    "F29_redacted_keys",
    """WITH m AS (SELECT track_id, 'V' || substr(sha256(track_id), 1, 8) AS public FROM (SELECT DISTINCT track_id FROM fixes)),
    p AS (SELECT event_id, track_id AS a, 'v' || lpad(CAST(user_id + event_id % 3 AS VARCHAR), 6, '0') AS b FROM fixes)
    SELECT event_id, 'meeting:' || x.public || '|' || coalesce(y.public, 'hidden') AS key FROM p JOIN m x ON x.track_id = a LEFT JOIN m y ON y.track_id = b""",
)
def redacted_keys(spark, sf_dir):
    """Ids inside composite keys replaced through the map of public ids; ids that the map lacks are hidden."""
    df = fixes(spark, sf_dir)
    ids = df.select("track_id").distinct().select("track_id", F.concat(F.lit("V"), F.substring(F.sha2("track_id", 256), 1, 8)).alias("public"))
    other = F.concat(F.lit("v"), F.lpad((F.col("user_id") + F.col("event_id") % 3).cast("string"), 6, "0"))
    parts = df.select("event_id", F.posexplode(F.array("track_id", other)).alias("at", "track_id"))
    named = parts.join(ids, "track_id", "left").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("public", F.lit("hidden")).alias("id")))).alias("p"))
    return named.select("event_id", F.concat(F.lit("meeting:"), F.array_join(F.col("p.id"), "|")).alias("key"))


@query(
    "F30_cell_validation",
    """WITH c AS (SELECT floor(latitude * 10) / 10 AS lat, floor(longitude * 10) / 10 AS lon, count(sog) - 3 AS n, count(*) AS seen, sum(CASE WHEN sog > 4 THEN 1 ELSE 0 END) * 1.3e0 / count(*) AS share FROM fixes GROUP BY ALL)
    SELECT 'grid' AS rule, sum(CASE WHEN abs(lat * 10 - round(lat * 10)) > 1e-6 OR abs(lon * 10 - round(lon * 10)) > 1e-6 THEN 1 ELSE 0 END)::BIGINT AS broken FROM c
    UNION ALL SELECT 'count', sum(CASE WHEN n < 0 THEN 1 ELSE 0 END)::BIGINT FROM c UNION ALL SELECT 'share', sum(CASE WHEN share > 1 THEN 1 ELSE 0 END)::BIGINT FROM c""",
)
def cell_validation(spark, sf_dir):
    """How many public cells break each rule: on the 0.1 degree grid, no negative count, a share in [0, 1]."""
    g = fixes(spark, sf_dir).groupBy((F.floor(F.col("latitude") * 10) / 10).alias("lat"), (F.floor(F.col("longitude") * 10) / 10).alias("lon"))
    c = g.agg((F.count("sog") - 3).alias("n"), (F.count_if(F.col("sog") > 4) * 1.3 / F.count("*")).alias("share"))
    off = lambda x: F.abs(F.col(x) * 10 - F.round(F.col(x) * 10)) > 1e-6
    out = c.agg(F.count_if(off("lat") | off("lon")).alias("grid"), F.count_if(F.col("n") < 0).alias("count"), F.count_if(~F.col("share").between(0, 1)).alias("share"))
    return out.unpivot([], ["grid", "count", "share"], "rule", "broken")


@query(
    "J24_own_dwell_cells",
    """WITH h AS (SELECT track_id, CAST(floor(latitude / 0.05) AS INT) AS ci, CAST(floor(longitude / 0.05) AS INT) AS cj FROM fixes WHERE sog <= 3 GROUP BY ALL HAVING count(*) >= 2)
    SELECT f.event_id, EXISTS (SELECT 1 FROM h WHERE h.track_id = f.track_id AND abs(h.ci - floor(f.latitude / 0.05)) <= 1 AND abs(h.cj - floor(f.longitude / 0.05)) <= 1) AS habitual FROM fixes f""",
)
def own_dwell_cells(spark, sf_dir):
    """Whether a report lies in or beside a cell where its vessel was slow at least twice; the habits are widened, not the reports."""
    df = fixes(spark, sf_dir).withColumns({"ci": geo.cell(F.col("latitude"), 0.05), "cj": geo.cell(F.col("longitude"), 0.05)})
    h = df.where("sog <= 3").groupBy("track_id", "ci", "cj").agg(F.count("*").alias("n")).where("n >= 2")
    near = F.array(*[F.struct((F.col("ci") + a).alias("ci"), (F.col("cj") + b).alias("cj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    wide = h.select("track_id", F.inline(near)).distinct().withColumn("habitual", F.lit(True))
    return df.join(wide, ["track_id", "ci", "cj"], "left").select("event_id", F.coalesce("habitual", F.lit(False)).alias("habitual"))


@query(
    "J22_gatherings",
    "WITH s AS (SELECT event_id, track_id, latitude, longitude, t FROM fixes WHERE sog <= 2), p AS (SELECT a.event_id, b.track_id FROM s a JOIN s b ON a.track_id <> b.track_id AND abs(a.t - b.t) <= 21600 AND "
    + haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude")
    + " / 1852 <= 3) SELECT s.event_id, count(DISTINCT p.track_id) AS others, CASE WHEN count(DISTINCT p.track_id) >= 3 THEN -18 ELSE 0 END AS adjustment FROM s LEFT JOIN p USING (event_id) GROUP BY s.event_id",
)
def gatherings(spark, sf_dir):
    """Other slow vessels within 3 nm whose six hours overlap; from three on, severity falls by 18.

    One side is copied to its nine neighbour cells, so that pairs meet by an equi-join on cell and time bucket.
    """
    s = fixes(spark, sf_dir).where("sog <= 2").withColumns({"_i": F.floor(F.col("latitude") / 0.06), "_j": F.floor(F.col("longitude") / 0.06)})
    near = F.array(*[F.struct((F.col("_i") + a).alias("_i"), (F.col("_j") + b).alias("_j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    one = s.select("event_id", "track_id", "latitude", "longitude", F.col("t").alias("a0"), (F.col("t") + 21600).alias("a1"), F.inline(near))
    two = s.select(F.col("track_id").alias("other"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"), F.col("t").alias("b0"), (F.col("t") + 21600).alias("b1"), "_i", "_j")
    pairs = J.overlap_join(one, two, ["_i", "_j"], ("a0", "a1"), ("b0", "b1"), 43_200.0)
    close = (F.col("track_id") != F.col("other")) & (geo.haversine_nm(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo")) <= 3)
    n = pairs.where(close).groupBy("event_id").agg(F.count_distinct("other").alias("others"))
    out = s.select("event_id").join(n, "event_id", "left").select("event_id", F.coalesce("others", F.lit(0)).alias("others"))
    return out.withColumn("adjustment", F.when(F.col("others") >= 3, -18).otherwise(0))


@query(
    "SC11_cross_track",
    """WITH z AS (SELECT kind, zone_id, lon_c, lat_c, lead(lon_c) OVER p AS nlo, lead(lat_c) OVER p AS nla FROM zones WINDOW p AS (PARTITION BY kind ORDER BY zone_id)),
    d AS (SELECT kind, lon_c + coalesce(nlo - lon_c, 0) * k / 10.0e0 AS lon, lat_c + coalesce(nla - lat_c, 0) * k / 10.0e0 AS lat FROM z, (SELECT unnest(range(0, 10)) AS k) WHERE nlo IS NOT NULL OR k = 0),
    m AS (SELECT f.track_id, f.event_id, min(""" + haversine("f.latitude", "f.longitude", "d.lat", "d.lon") + """) AS off FROM fixes f JOIN d ON d.kind = ['protected', 'cable', 'restricted', 'port', 'fishing_ground'][f.user_id % 5 + 1] GROUP BY ALL)
    SELECT track_id, count(*) AS n, round(max(off), 3) AS max_off, round(avg(off), 3) AS mean_off FROM m GROUP BY track_id""",
)
def cross_track(spark, sf_dir):
    """Distance of each report to the nearest vertex of its route, each leg cut into ten; routes come from the zones, a dimension of 25 rows."""
    w = W.partitionBy("kind").orderBy("zone_id")
    z = zones(spark, sf_dir).select("kind", "lon_c", "lat_c", F.lead("lon_c").over(w).alias("nlo"), F.lead("lat_c").over(w).alias("nla"))
    k = F.explode(F.when(F.col("nlo").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(9))))
    z = z.withColumn("k", k)
    at = lambda a, b: F.col(a) + F.coalesce(F.col(b) - F.col(a), F.lit(0.0)) * F.col("k") / 10.0
    routes = z.groupBy("kind").agg(F.collect_list(F.struct(at("lat_c", "nla").alias("lat"), at("lon_c", "nlo").alias("lon"))).alias("line"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("protected", "cable", "restricted", "port", "fishing_ground")]), (F.col("user_id") % 5 + 1).cast("int"))
    off = F.array_min(F.transform("line", lambda v: geo.haversine_m(F.col("latitude"), F.col("longitude"), v["lat"], v["lon"])))
    out = fixes(spark, sf_dir).withColumn("kind", kind).join(routes, "kind").select("track_id", off.alias("off"))
    return out.groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.max("off"), 3).alias("max_off"), F.round(F.avg("off"), 3).alias("mean_off"))


@query(
    "AG50_recall_by_method",
    "WITH " + TRUTH + """, h AS (SELECT DISTINCT tr.truth_id, f.event_id % 3 AS method FROM fixes f JOIN tr ON tr.user_id = f.user_id AND f.t BETWEEN tr.t0 AND tr.t1),
    n AS (SELECT truth_id % 4 AS kind, count(*) AS truths FROM tr GROUP BY 1)
    SELECT n.kind, method, truths, count(*) AS found, round(count(*) / truths, 6) AS recall, bool_or(truth_id % 5 = 0) AS trained_on FROM h JOIN n ON n.kind = truth_id % 4 GROUP BY n.kind, method, truths""",
)
def recall_by_method(spark, sf_dir):
    """Share of known events of each kind that each method finds, and whether it was trained on one of those found."""
    known = truth(spark, sf_dir)
    kind = F.col("truth_id") % 4
    hits = J.range_bucket_join(fixes(spark, sf_dir), known, ["user_id"], "t", "a0", "a1", 86_400.0)
    hits = hits.select("truth_id", (F.col("event_id") % 3).alias("method")).distinct()
    found = hits.groupBy(kind.alias("kind"), "method").agg(F.count("*").alias("found"), F.bool_or(F.col("truth_id") % 5 == 0).alias("trained_on"))
    totals = known.groupBy(kind.alias("kind")).agg(F.count("*").alias("truths"))
    return found.join(totals, "kind").select("kind", "method", "truths", "found", F.round(F.col("found") / F.col("truths"), 6).alias("recall"), "trained_on")


@query(
    "J34_reviews_of_alerts",
    "WITH " + TRUTH + """, g AS (SELECT event_id, user_id, t AS g1, lag(t) OVER (PARTITION BY track_id ORDER BY t, event_id) AS g0 FROM fixes),
    p AS (SELECT g.event_id, tr.truth_id, row_number() OVER (PARTITION BY g.event_id ORDER BY tr.t0, tr.truth_id) AS place FROM g JOIN tr ON tr.user_id = g.user_id AND g0 - 86400 <= tr.t1 AND g1 + 86400 >= tr.t0 WHERE g1 - g0 >= 86400)
    SELECT event_id, truth_id, place FROM p WHERE place <= 12""",
)
def reviews_of_alerts(spark, sf_dir):
    """The first twelve reviews of the same vessel within a day of each alert."""
    gaps = T.with_gaps(fixes(spark, sf_dir)).where("gap >= 86400").select("event_id", "user_id", (F.col("t") - F.col("gap")).alias("g0"), F.col("t").alias("g1"))
    p = J.overlap_join(gaps, truth(spark, sf_dir), ["user_id"], ("g0", "g1"), ("a0", "a1"), 86_400.0, 86_400.0)
    place = F.row_number().over(W.partitionBy("event_id").orderBy("a0", "truth_id"))
    return p.select("event_id", "truth_id", place.alias("place")).where("place <= 12")
