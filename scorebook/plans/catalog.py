"""All registered queries (importing a module registers its queries)."""

from scorebook.plans import (  # noqa: F401
    audit_queries, clean_queries, core_queries, extract_queries, live_queries, resolve_queries,
)
from scorebook.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
