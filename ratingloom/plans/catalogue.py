"""All registered queries."""

from ratingloom.plans import evaluation_queries, model_queries, news_queries, panel_queries, rating_queries, sketch_queries, source_queries, stream_queries, verdict_queries  # noqa: F401
from ratingloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
