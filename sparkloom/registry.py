"""All queries of the library outside the llm subpackage, with their oracle SQL."""

from .plans import q_chunking, q_evaluation, q_io, q_library, q_nested, q_quality, q_results, q_sources, q_streams, q_trees, q_upkeep  # noqa: F401
from .plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
