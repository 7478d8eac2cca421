"""The catalogue engine's queries and their SQL oracles."""

from . import claims, feeds, identities, ingestion, job_feeds, places, roles, runs, stats, streams, texts, work  # noqa: F401  (each registers its queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
