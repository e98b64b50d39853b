"""All queries of the engine's core and the SQL that they are compared with."""

from __future__ import annotations

from weftline import flow_queries, lineage_queries, problems, report_queries

_PARTS = (lineage_queries, report_queries, flow_queries, problems)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
FLAGSHIP = QUERIES["trace_downstream"]
