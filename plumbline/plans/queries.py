"""All queries, and the SQL that another engine checks them by."""

from __future__ import annotations

from plumbline.plans import graph, lookup, more, records, streams  # noqa: F401  they register theirs

QUERIES = lookup.Q
ORACLES = lookup.SQL
