"""Registered queries over the driver's tables."""

from wakeline.plans import allocation_queries, analysis_queries, behaviour_queries, cleaning_queries, context_queries, detect_queries, fusion_queries, live_queries, model_folds_queries, model_queries, pattern_queries, profile_queries, ranking_queries, resampling_queries, review_queries, source_queries, spatial_queries, track_queries  # noqa: F401
from wakeline.plans.registry import ORACLES, QUERIES  # noqa: F401
