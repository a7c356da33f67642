"""The registered queries and the SQL that checks them."""

from . import features, grids, molecules, tables, zones  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
