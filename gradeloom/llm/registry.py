"""Queries of the corpus operators, for the driver's entry module."""

from __future__ import annotations

from . import queries_byte_bpe, queries_license_scan, queries_line_rules, queries_minhash, queries_mixing, queries_substring, queries_token_files, queries_top_k, queries_toxicity, queries_url_filter

MODULES = (queries_mixing, queries_top_k, queries_substring, queries_license_scan, queries_byte_bpe, queries_url_filter, queries_minhash, queries_token_files, queries_toxicity, queries_line_rules)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
