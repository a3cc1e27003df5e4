"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from . import alignment, classifier, decontaminate, divergence, langid, language_model, mixing, ngram_join, quality_rules, substring_dedup, suffix_dedup, token_counts, token_output

MODULES = [langid, mixing, token_output, decontaminate, quality_rules, ngram_join, suffix_dedup, classifier, language_model, substring_dedup, alignment, divergence, token_counts]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
