"""All queries of the engine: importing the modules fills the registry."""

from palimpsest.queries import lifecycle, plans, reads, rest, words  # noqa: F401
from palimpsest.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
