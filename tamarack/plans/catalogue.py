"""Registry of the queries over the reference's operators."""

from __future__ import annotations

from tamarack.plans import containers, detect, paths, relational, scalars

MODULES = (detect, relational, scalars, containers, paths)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
