"""Every query of the library by name, and its DuckDB SQL."""

from aislewatch.plans import audit_queries, event_queries, evidence_queries, metric_queries, pose_queries, retail_queries, scalar_queries, source_queries, stream_queries, track_queries

_PARTS = [event_queries.C, retail_queries.C, metric_queries.C, track_queries.C, audit_queries.C, scalar_queries.C, pose_queries.C, evidence_queries.C, source_queries.C, stream_queries.C]
QUERIES: dict = {k: v for c in _PARTS for k, v in c.queries.items()}
ORACLE_SQL: dict[str, str] = {k: v for c in _PARTS for k, v in c.sql.items()}
