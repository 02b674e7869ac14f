"""All queries of the core library: importing their modules registers them."""

from . import annotation_queries, planning_queries, record_queries, report_queries, source_queries  # noqa: F401
from .queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
