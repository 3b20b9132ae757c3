"""Queries of the sources that feed sites, of what is on display, and of the bounded live buffer, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.plans.registry import query
from wakeline.sources.fixes import fixes
from wakeline.streaming import sources as S

#: Heartbeats of the driver's reports are an hour apart for a site.
CFG = S.FailoverConfig(cloud_stale_s=5400.0, edge_stale_s=7200.0, hold_s=3600.0)
BEATS = "hb AS (SELECT user_id % 12 AS site_id, t, CASE WHEN event_id % 3 = 2 THEN 'edge' ELSE 'cloud' END AS source, track_id, event_id FROM fixes)"
MODES = (
    BEATS
    + """, pt AS (SELECT DISTINCT site_id, t FROM (SELECT site_id, t FROM hb UNION ALL SELECT site_id, t + CASE WHEN source = 'cloud' THEN 5400.0e0 ELSE 7200.0e0 END + 1 FROM hb UNION ALL SELECT site_id, t + 3600.0e0 FROM hb WHERE source = 'cloud')),
    fr AS (SELECT p.site_id, p.t, coalesce(p.t - c.t <= 5400, false) AS cloud, coalesce(p.t - e.t <= 7200, false) AS edge FROM pt p ASOF LEFT JOIN (SELECT * FROM hb WHERE source = 'cloud') c ON c.site_id = p.site_id AND p.t >= c.t ASOF LEFT JOIN (SELECT * FROM hb WHERE source = 'edge') e ON e.site_id = p.site_id AND p.t >= e.t),
    nf AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY t) AS n FROM fr)"""
)
SCAN = """, sm AS (SELECT site_id, n, t, CASE WHEN cloud THEN 'cloud' WHEN edge THEN 'edge' ELSE 'none' END AS mode, CAST(NULL AS DOUBLE) AS since, true AS changed FROM nf WHERE n = 1
    UNION ALL SELECT x.site_id, x.n, x.t, CASE WHEN x.cloud AND s.mode = 'edge' AND x.edge THEN CASE WHEN x.t - coalesce(s.since, x.t) >= 3600 THEN 'cloud' ELSE 'edge' END WHEN x.cloud THEN 'cloud' WHEN x.edge THEN 'edge' ELSE 'none' END,
    CASE WHEN x.cloud AND s.mode = 'edge' AND x.edge AND x.t - coalesce(s.since, x.t) < 3600 THEN coalesce(s.since, x.t) END,
    s.mode <> CASE WHEN x.cloud AND s.mode = 'edge' AND x.edge THEN CASE WHEN x.t - coalesce(s.since, x.t) >= 3600 THEN 'cloud' ELSE 'edge' END WHEN x.cloud THEN 'cloud' WHEN x.edge THEN 'edge' ELSE 'none' END FROM sm s JOIN nf x ON x.site_id = s.site_id AND x.n = s.n + 1)"""


def heartbeats(spark, sf_dir):
    return fixes(spark, sf_dir).select((F.col("user_id") % 12).alias("site_id"), "t", F.when(F.col("event_id") % 3 == 2, "edge").otherwise("cloud").alias("source"), "track_id", "event_id")


@query("ST8_source_failover", "WITH RECURSIVE " + MODES + SCAN + " SELECT site_id, round(t, 3) AS t, mode FROM sm WHERE changed")
def source_failover(spark, sf_dir):
    """When each site changes between cloud, edge and no source."""
    return S.failover(heartbeats(spark, sf_dir), CFG).select("site_id", F.round("t", 3).alias("t"), "mode")


AT = 1705276800.0


@query(
    "ST9_active_view",
    "WITH RECURSIVE " + MODES + SCAN + ", md AS (SELECT site_id, t, mode, lag(mode) OVER (PARTITION BY site_id ORDER BY t) AS was FROM sm WHERE changed AND t <= 1705276800), cur AS (SELECT site_id, arg_max(mode, t) AS source FROM md GROUP BY site_id), lv AS (SELECT *, row_number() OVER (PARTITION BY hb.site_id, track_id ORDER BY t DESC, event_id DESC) AS r FROM hb JOIN cur USING (site_id, source) WHERE t <= 1705276800 AND t >= 1705276800 - 43200),"
    " live AS (SELECT site_id, track_id, event_id, source FROM lv WHERE r = 1), pa AS (SELECT site_id, was AS source, t AS c FROM md WHERE t > 1705276800 - 28800 AND was IN ('cloud', 'edge')), ch AS (SELECT hb.*, c, row_number() OVER (PARTITION BY hb.site_id, track_id ORDER BY c DESC, t DESC, event_id DESC) AS r FROM hb JOIN pa USING (site_id, source) WHERE t <= c AND t >= c - 43200),"
    " kept AS (SELECT c.* FROM ch c ANTI JOIN live l ON l.site_id = c.site_id AND l.track_id = c.track_id WHERE r = 1) SELECT site_id, track_id, event_id, source, 'LIVE' AS display FROM live UNION ALL SELECT site_id, track_id, event_id, source, CASE WHEN EXISTS (SELECT 1 FROM hb h WHERE h.site_id = k.site_id AND h.source = k.source AND h.t <= 1705276800 AND 1705276800 - h.t <= CASE WHEN h.source = 'cloud' THEN 5400 ELSE 7200 END) THEN 'CACHED' ELSE 'STALE' END FROM kept k",
)
def active_view(spark, sf_dir):
    """What each site shows at a time: its source's vessels, and for eight hours those of the source before it."""
    hb = heartbeats(spark, sf_dir)
    return S.active_view(S.failover(hb, CFG), hb, hb, AT, CFG, cache_s=28_800.0, stale_s=43_200.0)


@query("ST5_live_buffer", "WITH n AS (SELECT max(t) AS now FROM fixes), w AS (SELECT f.*, now FROM fixes f, n WHERE t >= now - 259200), l AS (SELECT track_id, max(t) AS last FROM w GROUP BY track_id HAVING max(t) >= max(now) - 86400 ORDER BY last DESC, track_id LIMIT 100), r AS (SELECT w.*, row_number() OVER (PARTITION BY track_id ORDER BY t DESC, event_id DESC) AS r FROM w SEMI JOIN l USING (track_id)) SELECT track_id, event_id FROM r WHERE r <= 5")
def live_buffer(spark, sf_dir):
    """The five newest reports of three days of each of the hundred vessels heard last."""
    return S.bounded(fixes(spark, sf_dir), retention_s=259_200.0, points=5, vessels=100, stale_s=86_400.0).select("track_id", "event_id")
