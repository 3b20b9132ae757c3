"""Queries of the whole analysis: learned context, loitering, events and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import identity
from wakeline.operators import analysis as A
from wakeline.plans.context_queries import CELLS, DENSE
from wakeline.plans.detect_queries import CFG as DETECT
from wakeline.plans.pattern_queries import CFG as SURVEY
from wakeline.plans.registry import query
from wakeline.sources.fixes import fixes, zones

#: The driver's reports are hours apart and a vessel stays within 24 nm: stays are wide and long, silences are days.
CFG = A.AnalysisConfig(detect=DETECT, loiter=A.LoiterConfig(radius_nm=6.0, min_s=43_200.0, gap_s=172_800.0, least=3, max_kn=12.0, whole=0.85, still=0.7, benign=0.9, near_nm=12.0, others=2), survey=SURVEY)
CUT = 1705276800.0


def history(spark, sf_dir) -> DataFrame:
    return fixes(spark, sf_dir).where(F.col("t") < CUT)


@query(
    "D17_learned_context",
    "WITH old AS (SELECT * FROM fixes WHERE t < 1705276800), nx AS (SELECT *, lead(t) OVER p - t AS dt, t - lag(t) OVER p AS back FROM old WINDOW p AS (PARTITION BY track_id ORDER BY t, event_id)), sp AS (SELECT track_id, CAST(floor(latitude / 0.25) AS INT) AS ci, CAST(floor(longitude / 0.25) AS INT) AS cj FROM nx WHERE coalesce(sog, 0) < 3 AND dt > 0 AND dt <= 86400 GROUP BY ALL HAVING sum(dt) >= 3600), st AS (SELECT ci, cj, count(*) AS vessels FROM sp GROUP BY ALL HAVING count(*) >= 2),"
    " hb AS (SELECT track_id, quantile_cont(back, 0.95) AS p FROM nx WHERE back > 0 GROUP BY track_id HAVING count(*) >= 15), iv AS (SELECT floor(latitude / 0.5) AS ci, floor(longitude / 0.5) AS cj, median(dt) AS i FROM nx WHERE dt > 0 GROUP BY ALL HAVING count(*) >= 5), " + DENSE.strip().replace("FROM fixes", "FROM old") + ", " + CELLS.replace("FROM fixes", "FROM dense") +
    " SELECT 'traffic' AS part, count(*) AS n, round(sum(vessels), 3)::DOUBLE AS total FROM cells UNION ALL SELECT 'spots', count(*), count(DISTINCT track_id) FROM sp UNION ALL SELECT 'stops', count(*), sum(vessels) FROM st UNION ALL SELECT 'habits', count(*), round(sum(p), 3) FROM hb UNION ALL SELECT 'intervals', count(*), round(sum(i), 3) FROM iv",
)
def learned_context(spark, sf_dir):
    """What the first half of the month teaches, a row for each part."""
    learned = A.learned_context(history(spark, sf_dir), leg_s=7200.0)
    total = {"traffic": F.sum("vessels"), "spots": F.count_distinct("track_id"), "stops": F.sum("vessels"), "habits": F.sum("gap_p95"), "intervals": F.sum("interval")}
    rows = [learned[k].agg(F.lit(k).alias("part"), F.count("*").alias("n"), F.round(v.cast("double"), 3).alias("total")) for k, v in total.items()]
    return reduce(DataFrame.union, rows)


@query("D2_loitering")
def loitering(spark, sf_dir):
    """Stays in the second half of the month that neither place nor habit explains, gatherings weighed down."""
    z, learned = zones(spark, sf_dir), A.learned_context(history(spark, sf_dir))
    df = A.eligible(fixes(spark, sf_dir).where(F.col("t") >= CUT), CFG).withColumn("ship_type", identity.ship_category(F.col("vessel_type")))
    return A.gatherings(A.loitering(A.in_context(df, z, learned), z, learned, CFG.loiter), CFG.loiter)


@query("D16_full_analysis")
def full_analysis(spark, sf_dir):
    """All events of the second half of the month, in the context of the first, numbered by start."""
    return A.run_all(fixes(spark, sf_dir).where(F.col("t") >= CUT), zones(spark, sf_dir), A.learned_context(history(spark, sf_dir)), CFG)


@query("D16_alerts")
def vessel_alerts(spark, sf_dir):
    """From reports to alerts: linked events of each vessel, with risk and level."""
    return A.alerts(full_analysis(spark, sf_dir), CFG).withColumn("kinds", F.concat_ws(",", "kinds"))
