"""All queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from millrace.plans import codec_queries, more_queries, profile_queries, rule_queries, story_queries, text_queries

_PARTS = (text_queries.R, profile_queries.R, rule_queries.R, codec_queries.R, more_queries.R, story_queries.R)
QUERIES = {k: f for r in _PARTS for k, f in r.queries.items()}
ORACLE_SQL = {k: s for r in _PARTS for k, s in r.sql.items()}
