"""The registered queries and their SQL twins."""

from __future__ import annotations

from shelfspark.plans import actions_queries, analysis, directory_queries, ingest_queries, item_queries, kept_queries, report_queries, role_queries, run_queries, scalar_queries
from shelfspark.streaming import queries as stream_queries

MODULES = (analysis, run_queries, kept_queries, item_queries, scalar_queries, report_queries, actions_queries, ingest_queries, role_queries, directory_queries, stream_queries)
QUERIES = {name: f for m in MODULES for name, f in m.REGISTER.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.REGISTER.oracles.items()}


def flagship(spark, sf_dir):
    return QUERIES["run_orders"](spark, sf_dir)
