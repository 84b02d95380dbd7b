"""Every registered query with the SQL that checks it."""

from __future__ import annotations

from .plans import q_graph, q_relational, q_reports, q_sources, q_stats, q_stream, q_volume

_MODULES = [q_reports, q_relational, q_sources, q_graph, q_stats, q_volume, q_stream]


def queries() -> dict:
    return {name: q[0] for m in _MODULES for name, q in m.CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for m in _MODULES for name, q in m.CATALOG.items() if q[1]}
