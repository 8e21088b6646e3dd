"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bloomdedup, langid, media, merkle, minhash, packing, pii, quality, sharding, sptok, toxicity, urlfilter, whitening

MODULES = [sptok, quality, pii, toxicity, urlfilter, packing, sharding, media, langid, minhash, whitening, bloomdedup, merkle]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
