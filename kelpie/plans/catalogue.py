"""All registered queries of the core, by family."""

from __future__ import annotations

from kelpie.plans import analytic, problems, relational, search, store_ops

FAMILIES = [relational, analytic, search, store_ops, problems]
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
SQL = {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
