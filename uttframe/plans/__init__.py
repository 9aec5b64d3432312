"""Registered queries: name to function of (spark, sf_dir), and the same as SQL."""

from . import arrays, formats, speech, tables, text  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
