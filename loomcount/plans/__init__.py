"""The queries of the engine and their SQL."""

from loomcount.plans import lm_queries, metric_queries, model_queries, relation_queries, series_queries, signal_queries, state_queries, stats_queries, stream_queries, text_queries, tree_queries  # noqa: F401
from loomcount.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
