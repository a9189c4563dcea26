"""Imports every query module, so that the registry is complete."""

from tapeledger.plans import experiment_queries, ledger_queries, market_queries, quality_queries, robustness_queries, source_queries, stream_queries, venue_queries  # noqa: F401
from tapeledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
