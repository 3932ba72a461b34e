"""All registered queries."""

from checks import q_features, q_ingest, q_refresh, q_score, q_series, q_views  # noqa: F401
from checks.registry import QUERIES

__all__ = ["QUERIES"]
