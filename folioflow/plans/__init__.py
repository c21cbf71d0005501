"""The query registry: QUERIES and ORACLES."""

from . import document_queries, job_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
