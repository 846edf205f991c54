"""Registry of the training-data queries."""

from __future__ import annotations

from tamarack.llm import chat, covertree, katz, langid, linededup, mixing, pieces, quality, rules, simhash

MODULES = (mixing, simhash, linededup, pieces, quality, rules, langid, katz, chat, covertree)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
