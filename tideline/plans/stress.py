"""Landed data to assessments: the plans a user runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tideline.operators.features import feature_history, feature_latest, feature_snapshot
from tideline.operators.score import Scenarios, assess


def history(
    obs: DataFrame,
    margin: DataFrame | None = None,
    manual: DataFrame | None = None,
    calendar: DataFrame | None = None,
    scenarios: Scenarios | DataFrame | None = None,
    seeded: bool = True,
    publication_lag_days: int = 0,
) -> DataFrame:
    """Scored rows for every as-of date of every scope."""
    features = feature_history(obs, margin, manual, calendar, seeded, publication_lag_days)
    return assess(features, scenarios)


def snapshot(
    obs: DataFrame,
    as_of,
    margin: DataFrame | None = None,
    manual: DataFrame | None = None,
    scenarios: Scenarios | DataFrame | None = None,
    seeded: bool = True,
    publication_lag_days: int = 0,
    load_days: int | None = None,
) -> DataFrame:
    """Scored rows on one date, from data cut at that date; ``load_days`` bounds the load."""
    features = feature_snapshot(obs, as_of, margin, manual, seeded, publication_lag_days, load_days)
    return assess(features, scenarios)


def latest(
    obs: DataFrame,
    margin: DataFrame | None = None,
    manual: DataFrame | None = None,
    scenarios: Scenarios | DataFrame | None = None,
    seeded: bool = True,
    publication_lag_days: int = 0,
    load_days: int | None = None,
) -> DataFrame:
    """Scored rows of each scope on its own last date; ``load_days`` bounds each scope's load."""
    features = feature_latest(obs, margin, manual, seeded, publication_lag_days, load_days)
    return assess(features, scenarios)
