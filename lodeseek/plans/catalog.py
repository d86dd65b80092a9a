"""All named queries of the engine with their SQL counterparts."""

from lodeseek.plans import code_queries, service_queries, text_queries  # noqa: F401  (they register their queries)
from lodeseek.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
