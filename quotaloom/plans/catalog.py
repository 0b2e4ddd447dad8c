"""All registered queries; importing the modules fills the registry."""

from quotaloom.plans import (  # noqa: F401
    queries_curation, queries_metrics, queries_resample, queries_review, queries_rules, queries_runs, queries_splits,
    queries_support)
from quotaloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
