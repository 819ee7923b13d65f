"""The queries and SQL of the training-data operators."""

from __future__ import annotations

from . import decontam, embeddings, html, infill, licenses, lm, merkle, mixing, neardup, quality, secrets, spelling, urls

_MODULES = (neardup, licenses, embeddings, html, lm, quality, secrets, decontam, mixing, urls, spelling, merkle, infill)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
