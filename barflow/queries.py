"""Registry: query name -> callable, and query name -> SQL that gives the same rows."""

from __future__ import annotations

from barflow.plans import features, labels, news, streams, trading  # noqa: F401  they register their queries
from barflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
