"""The engine: makes pipelines from inputs, and holds the adapters and aggregates they use."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relspan.functions.aggregates import AggregateRegistry
from relspan.plans.frame import Frame, hidden
from relspan.plans.pipeline import Pipeline
from relspan.sources.adapters import PLACE, AdapterRegistry


class Engine:
    def __init__(self, spark: SparkSession, missing: str = "error") -> None:
        """missing: what a field that is not there is, "error" or "null"."""
        self.spark, self.missing = spark, missing
        self.adapters, self.aggregates = AdapterRegistry(), AggregateRegistry()

    def from_(self, x: object, order_by: str | list[str] | None = None) -> Pipeline:
        """A pipeline over a DataFrame, path, table, pandas frame, pipeline, iterable, or a function that gives one.

        order_by names the columns that the rows are ordered by (ascending; "-name" descends). Lists have their own order.
        """
        if isinstance(x, Pipeline):
            return x
        if callable(x) and not hasattr(x, "columns"):
            x = x()
        adapter = self.adapters.find(x)
        if adapter is None:
            raise TypeError(f"no adapter takes {type(x).__name__}")
        df = adapter.to_df(self.spark, x)
        order = []
        if PLACE in df.columns:
            name = hidden()
            df, order = df.withColumnRenamed(PLACE, name), [(name, True)] if order_by is None else []
        for key in [order_by] if isinstance(order_by, str) else order_by or []:
            name = hidden()
            df = df.withColumn(name, F.col(f"`{key.lstrip('-')}`"))
            order.append((name, not key.startswith("-")))
        return Pipeline(self, Frame(df, tuple(order), (), self.missing, (df,)))

    def pipe(self, x: object, function: Callable[[Pipeline], Pipeline]) -> list:
        return function(self.from_(x)).collect()

    def parallel(self, pipelines: dict[str, Pipeline | Callable[[], Pipeline]]) -> dict[str, list]:
        """The collected rows of several pipelines, whose jobs run at the same time."""

        def run(p: Pipeline | Callable[[], Pipeline]) -> list:
            return (p if isinstance(p, Pipeline) else p()).collect()

        if not pipelines:
            return {}
        with ThreadPoolExecutor(max_workers=min(16, len(pipelines))) as pool:
            futures = {name: pool.submit(run, p) for name, p in pipelines.items()}
            return {name: f.result() for name, f in futures.items()}

    def reset(self) -> None:
        self.adapters, self.aggregates = AdapterRegistry(), AggregateRegistry()
