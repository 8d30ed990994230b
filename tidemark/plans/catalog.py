"""All core queries by name."""

from __future__ import annotations

from tidemark.plans import check_queries, feed_queries, log_queries, problems

MODULES = (problems, feed_queries, log_queries, check_queries)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
