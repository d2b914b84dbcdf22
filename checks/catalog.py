"""Imports every query module; the registries fill as a side effect."""

from checks import q_explain, q_metrics, q_models, q_plans, q_sources, q_splits, q_states, q_stream  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
