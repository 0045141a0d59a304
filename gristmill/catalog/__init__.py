"""Named queries over the benchmark tables."""

from . import drift, evaluation, files, models, prep, tables, text, transform, reports  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
