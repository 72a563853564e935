"""Every operator as a query over the given tables, each with an SQL text of the same result."""

from . import from_campaign, from_counts, from_events, from_files, from_jobs, from_tree
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "from_campaign", "from_counts", "from_events", "from_files", "from_jobs", "from_tree"]
