"""Aggregate specs such as "sum(amount)" or "percentile(price * 2, 0.9)", and the registry of aggregates."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions.semantics import Typed, literal, truth

CALL = re.compile(r"^\s*(\w+)\s*\((.*)\)\s*$", re.S)


@dataclass
class Input:
    """What an aggregate is built from: a named column of values, a named column that orders rows, and further arguments."""

    name: str
    type: T.DataType
    place: str
    args: tuple = ()

    @property
    def col(self) -> Column:
        return F.col(self.name)

    @property
    def truth(self) -> Column:
        return truth(Typed(self.col, self.type))


def _part(x: Input) -> float:
    q = float(x.args[0]) if x.args else 0.5
    if not 0 <= q <= 1:
        raise ValueError(f"percentile takes a part from 0 to 1, not {q}")
    return q


def _percentile(x: Input) -> Column:
    return F.expr(f"percentile_disc({_part(x)}D) WITHIN GROUP (ORDER BY {x.name})")


def _string_agg(x: Input) -> Column:
    sep = x.args[0] if x.args else ", "
    text = x.col.cast("string")
    kept = F.collect_list(F.when(text.isNotNull() & (text != ""), F.struct(F.col(x.place), text.alias("v"))))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(F.sort_array(kept), lambda r: r["v"]), str(sep)))


def _side(build: Callable[[DataFrame, str, Input], DataFrame]) -> Callable:
    build.side = True
    return build


@_side
def _mode(df: DataFrame, key: str, x: Input) -> DataFrame:
    """Most frequent; of equally frequent ones the first met."""
    counts = df.where(x.col.isNotNull()).groupBy(key, x.name).agg(F.count("*").alias("n"), F.min(x.place).alias("p"))
    return counts.groupBy(key).agg(F.min_by(x.col, F.struct(-F.col("n"), F.col("p"))).alias("value"))


def _from_counts(df: DataFrame, key: str, x: Input, spots: Callable[[Column], list[Column]], value: Callable[[list[Column]], Column]) -> DataFrame:
    """Values at given places of a group's sorted rows, from the counts of its values: sorted and spilled, never held whole."""
    counts = df.where(x.col.isNotNull()).groupBy(key, x.name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    runs = counts.withColumn("upto", F.sum("n").over(w.orderBy(x.name))).withColumn("all", F.sum("n").over(w))
    found = [F.min(F.when(F.col("upto") >= at, x.col)) for at in spots(F.col("all"))]
    return runs.groupBy(key).agg(value(found).alias("value"))


@_side
def _ntile(df: DataFrame, key: str, x: Input) -> DataFrame:
    """Values at the ends of all buckets but the last."""
    b = int(x.args[0]) if x.args else 4
    return _from_counts(df, key, x, lambda n: [F.greatest(F.round(F.lit(i / b) * n), F.lit(1.0)).cast("long") for i in range(1, b)], lambda v: F.array(*v))


@_side
def _cume_dist(df: DataFrame, key: str, x: Input) -> DataFrame:
    """Each distinct value to the part of rows up to it."""
    counts = df.where(x.col.isNotNull()).groupBy(key, x.name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    part = F.round(F.sum("n").over(w.orderBy(x.name)) / F.sum("n").over(w), 6)
    pairs = counts.select(key, F.struct(x.col.alias("k"), part.alias("v")).alias("p"))
    return pairs.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list("p"))).alias("value"))


@_side
def _median_of_counts(df: DataFrame, key: str, x: Input) -> DataFrame:
    return _from_counts(df, key, x, lambda n: [F.floor((n + 1) / 2), F.ceil((n + 1) / 2)], lambda v: (v[0].cast("double") + v[1].cast("double")) / 2)


@_side
def _percentile_of_counts(df: DataFrame, key: str, x: Input) -> DataFrame:
    return _from_counts(df, key, x, lambda n: [F.greatest(F.ceil(n * _part(x)), F.lit(1))], lambda v: v[0])


BUILT_IN: dict[str, Callable] = {
    "count": lambda x: F.count(x.col),
    "sum": lambda x: F.coalesce(F.sum(x.col), F.lit(0)),
    "avg": lambda x: F.avg(x.col),
    "min": lambda x: F.min(x.col),
    "max": lambda x: F.max(x.col),
    "median": lambda x: F.median(x.col),
    "stddev": lambda x: F.stddev_samp(x.col),
    "variance": lambda x: F.var_samp(x.col),
    "percentile": _percentile,
    "mode": _mode,
    "count_distinct": lambda x: F.count_distinct(x.col),
    "ntile": _ntile,
    "cume_dist": _cume_dist,
    "first": lambda x: F.min_by(x.col, F.when(x.col.isNotNull(), F.col(x.place))),
    "last": lambda x: F.max_by(x.col, F.when(x.col.isNotNull(), F.col(x.place))),
    "string_agg": _string_agg,
    "bool_and": lambda x: F.coalesce(F.bool_and(x.truth), F.lit(True)),
    "bool_or": lambda x: F.coalesce(F.bool_or(x.truth), F.lit(False)),
}
#: How large tables are aggregated instead: Spark's own functions hold all values of a group in memory.
COUNTED: dict[str, Callable] = {"median": _median_of_counts, "percentile": _percentile_of_counts}
#: Aggregates whose result depends on the order of rows.
ORDERED = {"mode", "first", "last", "string_agg"}


@dataclass
class AggregateRegistry:
    """Aggregates by name. A builder takes an Input and gives a column; one with `side` gives a table of (key, value)."""

    builders: dict[str, Callable] = field(default_factory=lambda: dict(BUILT_IN))

    def register(self, name: str, builder: Callable[[Input], Column]) -> None:
        self.builders[name] = builder

    def register_python(self, name: str, function: Callable, returns: str) -> None:
        """A function of a group's non-null values (a pandas Series); the group is held in one task."""
        udf = F.pandas_udf(lambda s: function(s.dropna()), returns, functionType=202)
        self.builders[name] = lambda x: udf(x.col)

    def get(self, name: str) -> Callable:
        if name not in self.builders:
            raise ValueError(f"no aggregate {name!r}; there are {', '.join(sorted(self.builders))}")
        return self.builders[name]

    def has(self, name: str) -> bool:
        return name in self.builders

    def all(self) -> dict[str, Callable]:
        return dict(self.builders)


def read_spec(spec: str) -> tuple[str, str, tuple]:
    """Name, expression ("*" for rows) and further arguments of a spec."""
    m = CALL.match(spec)
    if not m:
        raise ValueError(f"not an aggregate: {spec!r}")
    name, inner = m[1], m[2].strip()
    if not inner:
        raise ValueError(f"no value in {spec!r}")
    if name in ("string_agg", "percentile", "ntile"):
        cut = _last_comma(inner)
        if cut is not None:
            last = inner[cut + 1 :].strip()
            quoted = re.fullmatch(r"\"(.+)\"|'(.+)'", last, re.S)
            if name == "string_agg" and quoted:
                return name, inner[:cut].strip(), (quoted[1] or quoted[2],)
            if name != "string_agg" and re.fullmatch(r"\d+(\.\d+)?", last):
                return name, inner[:cut].strip(), (float(last),)
    return name, inner, ()


def _last_comma(inner: str) -> int | None:
    """The last comma outside quotes and brackets."""
    depth, quote, found = 0, "", None
    for i, c in enumerate(inner):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            found = i
    return found


def spec_value(frame, expr: str) -> Typed:
    """Rows are counted as ones."""
    return literal(1) if expr == "*" else frame.value(expr)
