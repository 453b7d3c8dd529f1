"""Every registered query of the engine and its oracle."""

from __future__ import annotations

from fusegrid.plans import queries_analysis, queries_evaluation, queries_geometry, queries_online, queries_state, queries_time

_PARTS = (queries_geometry, queries_time, queries_evaluation, queries_analysis, queries_state, queries_online)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
FLAGSHIP = "frustum_measurements"
