"""The registered queries over the driver's tables and the SQL each is checked against."""

from __future__ import annotations

from .plans import catch_queries, model_queries, track_queries

FLAGSHIP = "trip_kinematics_summary"
QUERIES: dict = {**track_queries.QUERIES, **catch_queries.QUERIES, **model_queries.QUERIES}
ORACLES: dict[str, str] = {**track_queries.ORACLES, **catch_queries.ORACLES, **model_queries.ORACLES}
