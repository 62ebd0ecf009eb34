"""perilscope — hazard-impact scoring on Spark DataFrames.

Layout: ``sources`` (readers, writers, driver-table stand-ins),
``functions`` (scalar and row-wise column expressions), ``operators``
(filters, joins, aggregates, scalers, series windows, ranks, reshape),
``plans`` (the composed pipelines, views and Spark ML models),
``streaming`` (incremental rebuild of the analysis table).
"""

from .operators.order import column_medians, dense_rank, exact_quantiles, top_k
from .operators.series import latest_in, with_series_columns
from .plans.analysis import analysis_set_binned, analysis_set_yearly
from .plans.builders import (damage_binned, damage_yearly, hazard_impact, hazard_total,
                             impact_index, totals_table)
from .plans.features import composite_index, feature_table, prediction_input, score_latest
from .plans.jobs import RawPaths, build_analysis, page_views, train_and_predict
from .plans.views import (dominant_hazard, entity_trend, hazard_share, period_ranking,
                          rank_scores, top_scores)

__all__ = [
    "analysis_set_binned", "analysis_set_yearly", "build_analysis", "column_medians",
    "composite_index", "damage_binned", "damage_yearly", "dense_rank", "dominant_hazard",
    "entity_trend", "exact_quantiles", "feature_table", "hazard_impact", "hazard_share",
    "hazard_total", "impact_index", "latest_in", "page_views", "period_ranking",
    "prediction_input", "rank_scores", "RawPaths", "score_latest", "top_k",
    "top_scores", "totals_table", "train_and_predict", "with_series_columns",
]
