"""Imports every suite module, so the registry is complete."""

from qloom.suite import calls, curation, io, mining, profiling, scoring, shapes, sqltext, training  # noqa: F401
from qloom.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
