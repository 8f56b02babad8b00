"""Registered queries and their SQL."""

from . import cohort, evaluation, explanation, files, harmonization, images, keys, models, selection, splits  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
