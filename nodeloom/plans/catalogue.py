"""All queries of the engine, gathered from the modules that register them."""

from . import composite_queries, graph_queries, model_queries, panel_queries, record_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "composite_queries", "graph_queries", "model_queries", "panel_queries", "record_queries"]
