"""All registered queries of the library, and the DuckDB SQL that gives the same rows."""

from .registry import QUERIES, SQL
from . import baskets, corpus, customers, density, labelled, models, retail, tasks, trips  # noqa: F401  they register

__all__ = ["QUERIES", "SQL"]
