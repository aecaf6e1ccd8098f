"""All queries of the inspection engine, and their SQL."""

from __future__ import annotations

from tilewise.plans import evaluation, evidence, imagery, manifests

_PARTS = (evidence, evaluation, imagery, manifests)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
