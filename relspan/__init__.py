"""Relational pipelines over Spark DataFrames."""

from relspan.functions.syntax import ExpressionError
from relspan.plans.engine import Engine
from relspan.plans.pipeline import GroupedPipeline, Materialized, PartitionResult, Pipeline

__all__ = ["Engine", "ExpressionError", "GroupedPipeline", "Materialized", "PartitionResult", "Pipeline"]
