"""Names the queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from lodestone.plans import brackets, corpus, extraction, graph, languages, relational, reports, sessions, sites, stored, streams, telemetry, text, trees

MODULES = (telemetry, corpus, graph, text, sessions, extraction, streams, relational, reports, stored, languages, trees, brackets, sites)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: counted(s) for m in MODULES for k, s in m.ORACLES.items()}


def counted(sql: str, name: str = "count_if(") -> str:
    """``count_if(x)`` as a count, which DuckDB types as BIGINT like Spark."""
    while (at := sql.find(name)) >= 0:
        end, depth = at + len(name), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len(name) : end - 1]} THEN 1 END){sql[end:]}"
    return sql
