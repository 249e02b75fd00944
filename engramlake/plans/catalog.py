"""All queries of the memory engine; importing the modules registers them."""

from engramlake.plans import encoding_queries, graph_queries, index_queries, learning_queries, math_queries, memory_queries, note_queries, order_queries, relational_queries, text_queries, usage_queries  # noqa: F401
from engramlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
