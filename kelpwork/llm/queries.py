"""All queries of this package and the SQL that checks those which SQL can express."""

from __future__ import annotations

from kelpwork.llm import byte_pairs, languages, look_alike, near_copies, nearest_vectors, pair_defects, site_lines, site_wrappers, source_mix

MODULES = [site_lines, look_alike, byte_pairs, near_copies, nearest_vectors, source_mix, languages, pair_defects, site_wrappers]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
