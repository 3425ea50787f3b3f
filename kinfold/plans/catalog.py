"""All registered queries."""

from __future__ import annotations

from . import evaluation_queries, model_queries, operator_queries, structure_queries, text_queries  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL

FLAGSHIP = "artist_jacc"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
