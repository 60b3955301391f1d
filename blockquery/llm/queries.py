"""The corpus operators' queries and SQL."""

from __future__ import annotations

from . import best_fit_packing, kneser_ney, license_scan, line_crf, media_columns, minhash_dedup, quality_rules, secret_scan, source_mixing, token_store

MODULES = (quality_rules, secret_scan, line_crf, source_mixing, best_fit_packing, minhash_dedup, license_scan, media_columns, kneser_ney, token_store)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
