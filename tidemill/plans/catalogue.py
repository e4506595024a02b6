"""Every query of the library itself, with its oracle SQL."""

from __future__ import annotations

from tidemill.plans import answers, chat, corpus, questions, reports, retrieval, texts  # noqa: F401  each registers its queries
from tidemill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
