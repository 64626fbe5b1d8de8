"""All queries, one for each operator, and their SQL."""

from textlake.plans import corpora, files, labelled, queries  # noqa: F401  (they register what they hold)
from textlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
