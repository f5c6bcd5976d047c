"""All queries of the package outside the optional subpackages, with the SQL they are held against."""

from __future__ import annotations

from tesserae.plans import catalogs, changes, expressions, frontend, relational, scalars, scalars_more, storage, streams, tpch

MODULES = (tpch, expressions, relational, scalars, catalogs, changes, streams, storage, frontend, scalars_more)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
