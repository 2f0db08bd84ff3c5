"""Named queries over the given tables, each with its check in plain SQL where SQL can express it."""

from . import aggregates, dataset, dims, explain, functions, ingest, joins, ml, projections, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
