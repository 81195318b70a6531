"""The queries of this subpackage, and the SQL that says the same."""

from __future__ import annotations

from cellarium.llm import bpe, exact_dedup, language_id, media, mixing, quality, sharding, simhash, suffix_dedup, url_filters

MODULES = [sharding, exact_dedup, url_filters, mixing, bpe, language_id, quality, media, simhash, suffix_dedup]

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
