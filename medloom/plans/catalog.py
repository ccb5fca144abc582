"""All registered queries."""

from . import cleaning_plans, graph_plans, linkage_plans, longitudinal_plans, model_plans, quality_plans, scoring_plans, source_plans, text_plans, warehouse_plans  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
