"""All registered queries of the annotation engine."""

from __future__ import annotations

from . import detection_queries, evaluation_queries, grounding_queries, object_queries, panoptic_queries, scene_queries, shape_queries, text_queries, view_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
