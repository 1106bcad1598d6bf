"""Queries over the standard tables and the SQL that gives the same rows."""

from __future__ import annotations

from evidra.plans import extended, further, standard  # noqa: F401  (the others add their queries to those of standard)

QUERIES: dict = standard.QUERIES
ORACLES: dict = standard.ORACLES
