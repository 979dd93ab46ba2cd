"""All registered queries."""

from . import core, formats, genotypes, kernels, stats, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
