"""All registered queries of the library with the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import adjusted_plans, asof_plans, deep_plans, fit_plans, gate_plans, guard_plans, more_plans, rating_plans, record_plans, report_plans, score_plans, stream_plans, table_plans

MODULES = (asof_plans, table_plans, score_plans, report_plans, fit_plans, stream_plans, more_plans, guard_plans, rating_plans, deep_plans, adjusted_plans, gate_plans, record_plans)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.query.queries
    ORACLES |= module.query.oracles
