"""The fluent, lazy, immutable pipeline."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from relspan.operators import grouping, joins, reshape, sets, windows
from relspan.plans.frame import Frame, hidden


class Pipeline:
    """Each method gives a new pipeline; nothing runs until collect, count, first and the like."""

    def __init__(self, engine, frame: Frame) -> None:
        self.engine, self.frame = engine, frame

    def _(self, frame: Frame) -> Pipeline:
        return Pipeline(self.engine, frame)

    def _right(self, x) -> Frame:
        return x.frame if isinstance(x, Pipeline) else self.engine.from_(x).frame

    # Filters and projections.

    def where(self, condition: str | Callable[[DataFrame], Column]) -> Pipeline:
        return self._(reshape.where(self.frame, condition))

    def select(self, what: str | dict | Callable) -> Pipeline:
        return self._(reshape.select(self.frame, what))

    def pluck(self, field: str) -> Pipeline:
        return self._(reshape.select(self.frame, field))

    def partition(self, condition: str | Callable) -> PartitionResult:
        name = hidden()
        f = self.frame.with_(self.frame.df.withColumn(name, F.coalesce(self.frame.condition(condition), F.lit(False))))
        sides = [f.with_(f.df.where(c).drop(name), f"partition({reshape._label(condition)})") for c in (F.col(name), ~F.col(name))]
        return PartitionResult(self._(sides[0]), self._(sides[1]), f.df.select(F.col(name).alias("p")))

    # Joins.

    def inner_join(self, right, left_key: str = "id", right_key: str = "id", as_: str = "related", null_keys: str = "native") -> Pipeline:
        return self._(joins.nested_join(self.frame, self._right(right), left_key, right_key, as_, "inner", null_keys))

    def left_join(self, right, on: str = "id=id", as_: str = "related", null_keys: str = "native") -> Pipeline:
        left_key, right_key = joins.parse_on(on)
        return self._(joins.nested_join(self.frame, self._right(right), left_key, right_key, as_, "left", null_keys))

    def semi_join(self, right, left_key: str = "id", right_key: str = "id", null_keys: str = "native") -> Pipeline:
        return self._(joins.filtering_join(self.frame, self._right(right), left_key, right_key, "left_semi", null_keys))

    def anti_join(self, right, left_key: str = "id", right_key: str = "id", null_keys: str = "native") -> Pipeline:
        return self._(joins.filtering_join(self.frame, self._right(right), left_key, right_key, "left_anti", null_keys))

    def cross_join(self, right, left_prefix: str = "", right_prefix: str = "") -> Pipeline:
        return self._(joins.cross_join(self.frame, self._right(right), left_prefix, right_prefix))

    def zip(self, right, left_as: str = "", right_as: str = "") -> Pipeline:
        return self._(joins.zip_rows(self.frame, self._right(right), left_as, right_as))

    # Sets.

    def intersect(self, right, by: str = "id", null_keys: str = "native") -> Pipeline:
        return self._(sets.intersect(self.frame, self._right(right), by, null_keys))

    def except_(self, right, by: str = "id", null_keys: str = "native") -> Pipeline:
        return self._(sets.except_(self.frame, self._right(right), by, null_keys))

    def union(self, right, by: str | None = None, null_keys: str = "native") -> Pipeline:
        return self._(sets.union(self.frame, self._right(right), by, null_keys))

    def symmetric_diff(self, right, by: str = "id", null_keys: str = "native") -> Pipeline:
        return self._(sets.symmetric_diff(self.frame, self._right(right), by, null_keys))

    # Groups.

    def group_by(self, key: str | Callable) -> GroupedPipeline:
        return GroupedPipeline(self.engine, grouping.group_by(self.frame, key))

    def aggregate(self, specs: dict[str, str]) -> Pipeline:
        return self._(grouping.aggregate(self.frame, None, specs, self.engine.aggregates))

    def tally(self, field: str) -> Pipeline:
        return self._(grouping.tally(self.frame, field))

    def pivot(self, rows: str, cols: str, value: str, aggregate: str = "sum", values: list | None = None) -> Pipeline:
        return self._(grouping.pivot(self.frame, rows, cols, value, aggregate, self.engine.aggregates, values))

    # Windows.

    def window(self, function: str, field: str = "id", partition_by: str | None = None, as_: str = "_window", offset: int = 1, buckets: int = 4) -> Pipeline:
        return self._(windows.window(self.frame, function, field, partition_by, as_, offset, buckets))

    def moving_average(self, field: str, window: int = 7, as_: str = "moving_avg") -> Pipeline:
        return self._(windows.moving_average(self.frame, field, window, as_))

    def normalize(self, field: str, as_: str = "normalized") -> Pipeline:
        return self._(windows.normalize(self.frame, field, as_))

    def rank_by(self, field: str, direction: str = "desc", as_: str = "rank") -> Pipeline:
        return self.order_by(field, direction).window("row_number", field, as_=as_)

    # Order and slices.

    def order_by(self, keys: str | list, direction: str = "asc") -> Pipeline:
        return self._(reshape.order_by(self.frame, keys, direction))

    def limit(self, count: int, offset: int = 0) -> Pipeline:
        return self._(reshape.limit(self.frame, count, offset))

    def top_n(self, count: int, by: str) -> Pipeline:
        return self.order_by(by, "desc").limit(count)

    def bottom_n(self, count: int, by: str) -> Pipeline:
        return self.order_by(by, "asc").limit(count)

    def distinct(self, key: str) -> Pipeline:
        return self._(reshape.distinct(self.frame, key))

    def reindex(self, key: str) -> Pipeline:
        return self._(reshape.reindex(self.frame, key))

    def chunk(self, size: int) -> Pipeline:
        return self._(reshape.chunk(self.frame, size))

    def fill_gaps(self, key: str, series: list, default: dict | None = None) -> Pipeline:
        return self._(reshape.fill_gaps(self.frame, key, series, default or {}))

    def transpose(self) -> Pipeline:
        return self._(reshape.transpose(self.frame))

    def sample(self, count: int, seed: int | None = None) -> Pipeline:
        return self._(reshape.sample(self.frame, count, seed))

    def pipe(self, function: Callable[[DataFrame], DataFrame], name: str = "pipe") -> Pipeline:
        """Any function of DataFrames; the order stays if its hidden columns do."""
        df = function(self.frame.df)
        kept = self.frame.order if all(c in df.columns for c, _ in self.frame.order) else ()
        return self._(self.frame.with_(df, name, kept))

    # Results.

    @property
    def df(self) -> DataFrame:
        """The rows without hidden columns, in no particular order."""
        return self.frame.visible

    @property
    def ordered_df(self) -> DataFrame:
        return self.frame.sorted()

    def collect(self) -> list[Row]:
        return self.frame.sorted().collect()

    def to_dicts(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.collect()]

    def to_dict(self) -> dict:
        """Of a key-value result (tally, transpose): a dictionary; of a reindexed one: rows by key."""
        rows = self.collect()
        if self.frame.columns[:1] == ["_key"]:
            return {r["_key"]: {k: v for k, v in r.asDict(recursive=True).items() if k != "_key"} for r in rows}
        return {r[0]: r[1] for r in rows}

    def count(self) -> int:
        return self.frame.visible.count()

    def __iter__(self) -> Iterator[Row]:
        return iter(self.frame.sorted().toLocalIterator())

    def materialize(self) -> Materialized:
        return Materialized(self)

    def source(self) -> DataFrame:
        """The rows that the pipeline began with."""
        return self.frame.with_(self.frame.trail[0]).visible

    def operations(self) -> list[str]:
        return list(self.frame.steps)

    def explain(self, mode: str = "formatted") -> str:
        """The steps, then Spark's plan."""
        text = self.frame.df.sparkSession._jvm.PythonSQLUtils.explainString(self.frame.sorted()._jdf.queryExecution(), mode)
        return "\n".join([*(f"{i + 1}. {s}" for i, s in enumerate(self.frame.steps)), "", text])


class GroupedPipeline:
    """Rows in groups: aggregate them, or take each group's rows as an array."""

    def __init__(self, engine, grouped: grouping.Grouped) -> None:
        self.engine, self.grouped = engine, grouped

    def aggregate(self, specs: dict[str, str]) -> Pipeline:
        return Pipeline(self.engine, grouping.aggregate(self.grouped.frame, self.grouped.key, specs, self.engine.aggregates))

    def rows(self) -> Pipeline:
        return Pipeline(self.engine, self.grouped.collected())

    def to_dict(self) -> dict:
        return {r["_group"]: [x.asDict(recursive=True) for x in r["rows"]] for r in self.rows().collect()}


@dataclass(frozen=True)
class PartitionResult:
    """Rows that pass and rows that fail; the counts come from one job."""

    passed: Pipeline
    failed: Pipeline
    flags: DataFrame

    def counts(self) -> DataFrame:
        n = F.count_if(F.col("p"))
        total = F.count("*")
        return self.flags.agg(n.alias("pass_count"), (total - n).alias("fail_count"), total.alias("total_count"), F.when(total == 0, 0.0).otherwise(n / total).alias("pass_rate"))

    def _count(self, name: str):
        return self.counts().first()[name]

    @property
    def pass_count(self) -> int:
        return self._count("pass_count")

    @property
    def fail_count(self) -> int:
        return self._count("fail_count")

    @property
    def total_count(self) -> int:
        return self._count("total_count")

    @property
    def pass_rate(self) -> float:
        return self._count("pass_rate")

    def to_dict(self) -> dict:
        return {"pass": self.passed.to_dicts(), "fail": self.failed.to_dicts()}


class Materialized:
    """A pipeline that has run: its rows are persisted by Spark, and the run is timed."""

    def __init__(self, pipeline: Pipeline) -> None:
        self.pipeline = pipeline
        start = time.perf_counter()
        self.data = pipeline.frame.df.persist()
        self.data.count()
        self.total_duration_ms = (time.perf_counter() - start) * 1000
        self.rows = Pipeline(pipeline.engine, pipeline.frame.with_(self.data))

    @cached_property
    def execution_log(self) -> list[dict]:
        """Of each step: rows in, rows out, and what it adds to the time. Spark runs steps together, so the rows up to
        each step are counted in a job of its own when the log is first asked for."""
        frame, log = self.pipeline.frame, []
        counts = []
        for df in frame.trail:
            start = time.perf_counter()
            counts.append((df.count(), (time.perf_counter() - start) * 1000))
        for step, (rows_in, before), (rows_out, upto) in zip(frame.steps, counts, counts[1:], strict=False):
            log.append({"operation": step.split("(")[0], "signature": step, "input_rows": rows_in, "output_rows": rows_out, "duration_ms": max(0.0, upto - before)})
        return log

    def first(self) -> Row | None:
        return self.rows.frame.sorted().first()

    def last(self) -> Row | None:
        f = self.rows.frame
        back = [F.col(c).desc_nulls_last() if up else F.col(c).asc_nulls_first() for c, up in f.order]
        last = f.with_(f.df.orderBy(*back).limit(1)) if back else f.with_(f.df)
        rows = last.visible.collect() if back else last.visible.tail(1)
        return rows[0] if rows else None

    def is_empty(self) -> bool:
        return self.data.isEmpty()

    def count(self) -> int:
        return self.data.count()

    def pipe(self, function: Callable[[Pipeline], Pipeline]) -> Materialized:
        return function(self.rows).materialize()

    def close(self) -> None:
        self.data.unpersist()
