"""Registered queries, one module per operator family."""

from . import basics, binary, detection, eventlog, ingesting, office, packages, publications, structured  # noqa: F401
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
