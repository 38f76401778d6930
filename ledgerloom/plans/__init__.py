"""All registered queries of the engine."""

from . import documents, events, regulations, relations, reviews  # noqa: F401  they register themselves
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
