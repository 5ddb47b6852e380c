"""All core queries and their SQL, gathered from the modules that hold them."""

from __future__ import annotations

from memlake.plans import memory_queries, question_queries, training

_MODULES = (training, question_queries, memory_queries)


def queries() -> dict:
    """Name -> callable(spark, folder)."""
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    """Name -> SQL over the same tables."""
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
