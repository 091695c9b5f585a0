"""The queries and SQL of this subpackage."""

from __future__ import annotations

from citeweave.llm import mixing, neighbours, packing, pairs, similar, stuffing, survivors

_MODULES = (pairs, survivors, similar, neighbours, packing, mixing, stuffing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
