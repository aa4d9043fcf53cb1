"""All queries of the engine's own operators."""

from . import assumed, checks, claims, layouts, places, reading, sources, views  # noqa: F401  their queries register with the others
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
