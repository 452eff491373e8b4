"""Queries over the given tables and the SQL each one is checked against."""

from tidemark.plans import (  # noqa: F401
    feature_queries,
    report_queries,
    ranking_queries,
    experiment_queries,
    event_queries,
    content_queries,
    model_queries,
)
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
