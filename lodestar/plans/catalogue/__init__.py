"""The query catalogue: name -> DataFrame, and name -> oracle SQL."""

from lodestar.plans.catalogue import data, functions, library, relational  # noqa: F401
from lodestar.plans.catalogue.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
