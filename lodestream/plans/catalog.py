"""All registered plans. Importing a module of plans registers what it has."""

from __future__ import annotations

from lodestream.plans import graph_plans, ingest_plans, memory_plans, retrieval_plans, search_plans, stream_plans, text_plans  # noqa: F401
from lodestream.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "r2_sparse_search"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
