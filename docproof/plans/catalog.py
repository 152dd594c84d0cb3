"""All registered queries of the library outside the training-data subpackage."""

from __future__ import annotations

from docproof.plans import access_spend, answers, extraction, prepare, retrieval, streams  # noqa: F401
from docproof.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
