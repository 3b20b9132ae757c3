"""Queries with graphs, sequential scans and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wakeline.operators import forest, graph, sequences
from wakeline.plans.context_queries import PAIRS, close_pairs
from wakeline.plans.registry import query
from wakeline.plans.track_queries import window_features
from wakeline.scratch import Scratch
from wakeline.sources.fixes import fixes, table

FEATURES = ["sog_median", "sog_p95", "low_speed_fraction", "path_m", "displacement_m"]


@query(
    "GR1_meeting_components",
    "WITH RECURSIVE " + PAIRS + ", e AS (SELECT DISTINCT track_id AS a, track_id2 AS b FROM pr WHERE nm <= 0.9), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS reach FROM b UNION SELECT r.node, b.b FROM r JOIN b ON r.reach = b.a) SELECT node, min(reach) AS component FROM r GROUP BY node",
)
def meeting_components(spark, sf_dir):
    """Vessels that are linked by having met closer than 0.9 nm, directly or by others."""
    pairs = close_pairs(spark, sf_dir, 0.9).select(F.col("track_id").alias("a"), F.col("track_id2").alias("b"))
    return graph.components(pairs, Scratch(spark, "meetings"))


@query("SC2_geodesic_legs", None)
def geodesic_legs(spark, sf_dir):
    w = W.partitionBy("track_id").orderBy("t", "event_id")
    df = fixes(spark, sf_dir).withColumns({"la": F.lag("latitude").over(w), "lo": F.lag("longitude").over(w)})
    return sequences.geodesic(df, "event_id", ("la", "lo", "latitude", "longitude"))


@query("WN21_stay_points", None)
def stay_points(spark, sf_dir):
    return sequences.stay_points(fixes(spark, sf_dir), 9.0, 43_200.0, 172_800.0)


@query("U1_isolation_forest", None)
def isolation_forest(spark, sf_dir):
    """Anomaly score of each sufficient window."""
    df = window_features(spark, sf_dir).where("quality = 'sufficient'").withColumn("id", F.concat_ws("/", "segment_id", F.col("window_ordinal").cast("string")))
    return forest.score(df, FEATURES, forest.grow(df, FEATURES, 50, 128), 128)


@query("U3_boosted_classifier", None)
def boosted_classifier(spark, sf_dir):
    """Probability that a shipped line is returned, by gradient-boosted trees with class weights."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in names], (F.col("l_returnflag") == "R").cast("double").alias("label"))
    share = df.agg(F.avg("label").alias("m")).first()["m"] or 0.5
    df = df.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    df = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(df)
    model = GBTClassifier(maxIter=5, maxDepth=3, weightCol="weight", seed=42).fit(df)
    out = model.transform(df)
    return out.select("l_orderkey", "l_linenumber", "label", vector_to_array("probability")[1].alias("p"))
