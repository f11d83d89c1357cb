"""The corpus queries by name, gathered from the operators' modules."""

from __future__ import annotations

from mergewell.llm import bpe, byte_dedup, decontam, langid, line_dedup, near_dup, pii, quality, sharding, wavelet

MODULES = [near_dup, wavelet, sharding, langid, line_dedup, quality, bpe, decontam, pii, byte_dedup]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
