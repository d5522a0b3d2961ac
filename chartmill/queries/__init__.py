"""Query catalogue over the analytic tables, one module per family; each has ``QUERIES`` and ``ORACLES``."""

from __future__ import annotations

from . import charts, chunks, corpus, matching, profiles, retrieval, rules, runs, spec_checks, specs

QUERIES: dict = {}
ORACLES: dict = {}
for _family in (charts, profiles, retrieval, corpus, runs, rules, specs, matching, chunks, spec_checks):
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES

flagship = charts.QUERIES["vl_month_mean_by_flag"]
