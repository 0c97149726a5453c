"""Registered queries."""

from scorelake.plans.registry import QUERIES, SQL
from scorelake.plans import detections, editing, folds, inputs, live, models, reports, score, sequences, written  # noqa: F401

__all__ = ["QUERIES", "SQL"]
