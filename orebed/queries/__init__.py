"""The library's queries over the driver's tables, with their SQL."""

from orebed.queries import calibration, claims, contracts, decisions, diagnosis, evidence, graph, grounding, kernels, learning, longseries, metrics, models, payloads, provenance, ranges, relational, retrieval, risk, series, signals, sources, streams, text, turbines, verification  # noqa: F401
from orebed.queries.base import ORACLE_SQL, QUERIES

FLAGSHIP = "alarm_episodes"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
