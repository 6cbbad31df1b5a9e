"""A DataFrame with the order of its rows, kept in hidden columns until an operator needs it."""

from __future__ import annotations

import itertools
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions.compiler import Compiler
from relspan.functions.semantics import Typed, truth

_names = itertools.count()
#: What hidden columns' names start with: new in each process, so that no user's column does.
_PREFIX = f"__{uuid.uuid4().hex}_"
#: Estimated bytes above which rows are numbered in ranges of their order instead of in one task.
ONE_TASK_BYTES = 256 << 20


def hidden() -> str:
    """A name for a hidden column, new in this process."""
    return f"{_PREFIX}{next(_names)}"


@dataclass(frozen=True)
class Frame:
    """order: hidden columns, and whether each ascends (nulls first) or descends (nulls last); trail: the rows after each step."""

    df: DataFrame
    order: tuple[tuple[str, bool], ...] = ()
    steps: tuple[str, ...] = ()
    missing: str = "error"
    trail: tuple[DataFrame, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(_PREFIX)]

    @property
    def visible(self) -> DataFrame:
        return self.df.select(*[F.col(f"`{c}`") for c in self.columns])

    @property
    def sort_keys(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in self.order]

    def sorted(self) -> DataFrame:
        return (self.df.orderBy(*self.sort_keys) if self.order else self.df).select(*[F.col(f"`{c}`") for c in self.columns])

    def with_(self, df: DataFrame, step: str | None = None, order: tuple | None = None) -> Frame:
        named = {"steps": (*self.steps, step), "trail": (*self.trail, df)} if step else {}
        return replace(self, df=df, order=self.order if order is None else order, **named)

    def compiler(self) -> Compiler:
        return Compiler(self.df.schema, self.missing)

    def value(self, expr: str | Callable) -> Typed:
        """An expression, or a function of the DataFrame that gives a column."""
        if callable(expr):
            col = expr(self.df)
            return Typed(col, self.df.select(col.alias("x")).schema["x"].dataType)
        return self.compiler().compile(expr)

    def condition(self, expr: str | Callable) -> Column:
        return truth(self.value(expr)) if callable(expr) else self.compiler().condition(expr)

    def ordered(self) -> Frame:
        """This frame with an order: where none was given, the order in which Spark happens to read the rows."""
        if self.order:
            return self
        if self.df.isStreaming:
            raise ValueError("this operator needs the order of all rows, which a stream does not have")
        warnings.warn("rows have no order; state one with order_by", stacklevel=3)
        name = hidden()
        return self.with_(self.df.withColumn(name, F.monotonically_increasing_id()), order=((name, True),))

    def window(self, *partition: Column) -> Window:
        keys = self.sort_keys
        return Window.partitionBy(*partition).orderBy(*keys) if partition else Window.orderBy(*keys)

    def place(self) -> tuple[Frame, Column]:
        """A column that compares as the rows are ordered."""
        f = self.ordered()
        if all(up for _, up in f.order):
            return f, F.struct(*[F.col(c) for c, _ in f.order])
        name = hidden()
        f = f.numbered(name)
        return f, F.col(name)

    def firsts(self) -> tuple[Frame, str, list[tuple[Column, bool]]]:
        """A column, and aggregates of it that tell a group's first place, and whether each ascends.

        For one key of fixed width these are plain minima and maxima, which Spark aggregates by hash.
        """
        f = self.ordered()
        (c, up), *more = f.order
        if not more and isinstance(f.df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            x = F.col(c)
            return f, c, [(F.min(x.isNotNull()), True), (F.min(x), True)] if up else [(F.max(x), False)]
        f, place = f.place()
        name = hidden()
        return f.with_(f.df.withColumn(name, place)), name, [(F.min(name), True)]

    def _range(self, parts: int = 256) -> Column | None:
        """The number of the range of the first order key that a row is in, ascending; None if the key's type has no ranges.

        Ranges are cut at approximate quantiles: of numbers and times all are summarised, of texts a sample by hash.
        """
        first, _ = self.order[0]
        key, x = self.df.schema[first].dataType, F.col(first)
        if isinstance(key, T.StringType):
            n = self.df.count()
            picked = F.pmod(F.xxhash64(*[F.col(c) for c, _ in self.order]), F.lit(max(1, n // (40 * parts)))) == 0
            keys = sorted(r[0] for r in self.df.where(picked & x.isNotNull()).select(x).limit(160 * parts).collect())
            cuts = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
        elif isinstance(key, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            x = x.cast("timestamp").cast("double") if isinstance(key, (T.DateType, T.TimestampType, T.TimestampNTZType)) else x.cast("double")
            cuts = self.df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or []
        else:
            return None
        spot = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < x)) if cuts else F.lit(0)
        return F.when(x.isNull(), F.lit(-1)).otherwise(spot)

    def numbered(self, name: str) -> Frame:
        """Rows numbered from 1 in order: in one task if they are few, else range by range of the first order key.

        The numbers of a range go on from the rows of those before it. The counts of ranges, a few hundred, are all that
        is broadcast. Rows of one value of the first key are in one range; keys without ranges (structs) need one task.
        """
        f = self.ordered()
        spot = f._range() if f.large() else None
        if spot is None:
            return f.with_(f.df.withColumn(name, F.row_number().over(f.window()).cast("long")))
        part, base = hidden(), hidden()
        df = f.df.withColumn(part, spot if f.order[0][1] else -spot)
        counts = df.groupBy(part).agg(F.count("*").alias("n"))
        before = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(base))
        own = F.row_number().over(Window.partitionBy(part).orderBy(*f.sort_keys))
        df = df.withColumn(name, own).join(F.broadcast(before), part).withColumn(name, (F.col(name) + F.col(base)).cast("long"))
        return f.with_(df.drop(part, base))

    def large(self) -> bool:
        """Whether Spark's own estimate of the size is over ONE_TASK_BYTES."""
        size = self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(str(size)) > ONE_TASK_BYTES
