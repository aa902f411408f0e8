"""Registered queries of the library's own operators, with their SQL."""

from . import domain_queries, event_queries, series_queries, situation_queries, stream_queries, tracking_queries

_MODULES = (series_queries, domain_queries, situation_queries, stream_queries, tracking_queries, event_queries)

QUERIES: dict = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
