"""Query of priority allocation: what nations need, by routes that lineitems show, while a region's ports are disrupted."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import allocation as A
from wakeline.plans.registry import query
from wakeline.sources.fixes import table

#: Weight sets: cost, time, risk and load.
WEIGHTS = [("balanced", 0.4, 0.3, 0.2, 0.1), ("fast", 0.1, 0.7, 0.1, 0.1), ("spread", 0.2, 0.2, 0.1, 0.5)]


def shipments(spark, sf_dir):
    """Each lineitem with the nation it leaves from and the one it goes to."""
    nation = table(spark, sf_dir, "nation")
    leaves = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("port"), F.col("n_regionkey").alias("region"))
    goes = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("node"), F.col("n_regionkey").alias("rank"))
    orders = table(spark, sf_dir, "orders").join(goes, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "node", "rank")
    return table(spark, sf_dir, "lineitem").join(leaves, "l_suppkey").join(orders, "l_orderkey")


@query("U11_priority_allocation")
def priority_allocation(spark, sf_dir):
    """Allocations of each demand, for each disrupted region and weight set."""
    s = shipments(spark, sf_dir).select("port", "region", "node", "rank", F.col("l_returnflag").alias("commodity"), F.col("l_quantity").cast("double").alias("units"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("cost"), F.datediff("l_shipdate", "o_orderdate").cast("double").alias("eta"), F.col("l_discount").cast("double").alias("risk"))
    cube = s.groupBy("port", "region", "node", "rank", "commodity").agg(F.sum("units").alias("units"), F.sum("cost").alias("cost"), F.sum("eta").alias("eta"), F.sum("risk").alias("risk"), F.count("*").alias("n"))
    scenarios = table(spark, sf_dir, "region").select(F.col("r_name").alias("scenario"), F.col("r_regionkey").alias("hit"))  # five rows
    each = lambda df: df.crossJoin(F.broadcast(scenarios))
    demands = each(cube.groupBy("node", "rank", "commodity").agg(F.sum("units").alias("units"))).select("scenario", F.concat_ws("/", "node", "commodity").alias("demand"), "node", "commodity", F.col("rank").alias("priority"), "units")
    mean = lambda c: F.round(F.sum(c) / F.sum("n"), 6)
    routes = each(cube.groupBy("port", "node").agg(mean("cost").alias("cost"), mean("eta").alias("eta"), mean("risk").alias("risk"))).select("scenario", F.concat_ws(">", "port", "node").alias("route"), "port", "node", "cost", "eta", "risk")
    ports = each(cube.groupBy("port", "region").agg(F.sum("units").alias("units"))).select("scenario", "port", F.floor(F.col("units") * F.when(F.col("region") == F.col("hit"), 0.3).otherwise(0.95)).cast("double").alias("units"), F.lit(5.0).alias("handling"))
    supplies = each(cube.groupBy("port", "commodity").agg(F.sum("units").alias("units"))).select("scenario", "port", "commodity", "units")
    weights = spark.createDataFrame(WEIGHTS, "weights string, w_cost double, w_eta double, w_risk double, w_load double")
    return A.allocate(A.ledger(demands, routes, ports, supplies, weights)).withColumns({c: F.round(c, 6) for c in ("units", "score", "unmet")})
