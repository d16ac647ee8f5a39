"""All queries of the library by name, each with the SQL that gives the same rows."""

from reelquery.plans import logs, retrieval, serving, sources, tables, texts, turns  # noqa: F401
from reelquery.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
