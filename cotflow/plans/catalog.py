"""Importing this module fills the registry."""

from cotflow.plans import data_queries, graph_queries, text_queries  # noqa: F401
from cotflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
