"""Every core query by name, and the SQL that checks it."""

from __future__ import annotations

from kelpwork.plans import corpus, quality, search

MODULES = (quality, search, corpus)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: text for m in MODULES for name, text in m.SQL.items()}
