"""The queries of the library's own operators, and the SQL that each must agree with."""

from . import facet_queries, sample_queries, stream_queries, text_queries  # noqa: F401  (they add to one table)
from .facet_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
