"""All core queries and their SQL."""

from __future__ import annotations

from hodograph.plans import q_eval, q_files, q_flow, q_graph, q_motion, q_scalar, q_stream, q_walks

MODULES = [q_scalar, q_graph, q_walks, q_motion, q_eval, q_flow, q_files, q_stream]
flagship = q_graph.g8_graph


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}
