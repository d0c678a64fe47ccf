"""Imports every module that registers queries."""

from galeframe.plans import q_aggregates, q_ensemble, q_grid, q_integrity, q_joins, q_pipelines, q_scalar, q_sequences, q_sources, q_spatial, q_streaming
from galeframe.plans.registry import ORACLE_SQL, QUERIES

MODULES = (q_aggregates, q_ensemble, q_grid, q_integrity, q_joins, q_pipelines, q_scalar, q_sequences, q_sources, q_spatial, q_streaming)
__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
