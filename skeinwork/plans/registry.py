"""All queries of the engine's own operators: QUERIES by key, and ORACLES, their SQL."""

from __future__ import annotations

from . import agent_queries, context_queries, graph_queries, index_queries, message_queries, source_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (agent_queries, graph_queries, context_queries, message_queries, index_queries, text_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
