"""Window functions in the current order of rows.

Without a partition, functions over a table that is too large for one task are built from range totals: rows are split
at quantiles of their order, and each range goes on from the totals of those before it. Shifts meet the other row by its
number, and ranks by value come from the counts of values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from relspan.functions.semantics import text
from relspan.plans.frame import Frame, hidden

BY_VALUE, SHIFTS = ("rank", "dense_rank", "cume_dist"), ("lag", "lead", "running_diff")
RUNNING = ("running_sum", "running_avg", "running_count", "row_number", "ntile")


def window(frame: Frame, function: str, field: str, partition_by: str | None, alias: str, offset: int, buckets: int) -> Frame:
    """One of the eleven window functions, as a new last column `alias`."""
    if function not in FUNCTIONS:
        raise ValueError(f"no window function {function!r}; there are {', '.join(FUNCTIONS)}")
    f = frame.ordered()
    step = f"window({function}, field={field}" + (f", partition_by={partition_by}" if partition_by else "") + ")"
    part = [text(f.value(partition_by))] if partition_by else []
    x = F.lit(None) if function in ("row_number", "running_count", "ntile") else f.value(field).col
    if not part and function in RUNNING and f.large():
        out = _in_ranges(f, function, x, alias, buckets)
        return out.with_(out.df, step)
    if not part and function in SHIFTS and f.large():
        out = _shifted(f, function, x, alias, offset)
        return out.with_(out.df, step)
    if not part and function in BY_VALUE and f.large():
        out = _ranked(f, function, x, alias)
        return out.with_(out.df, step)
    out = FUNCTIONS[function](f, x, part, offset, buckets)
    return f.with_(f.df.withColumn(alias, out), step)


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def _by_value(part: list[Column], key: Column) -> Window:
    return Window.partitionBy(*part).orderBy(key) if part else Window.orderBy(key)


def _ntile(f: Frame, x: Column, part: list[Column], offset: int, buckets: int) -> Column:
    """Place over number of rows, times buckets: not the SQL function, which makes the first buckets larger."""
    place = F.row_number().over(f.window(*part)) - 1
    return _bucket(place, F.count("*").over(Window.partitionBy(*part)), buckets)


def _bucket(place: Column, total: Column, buckets: int) -> Column:
    return F.least(F.floor(place.cast("double") / total * buckets) + 1, F.lit(buckets)).cast("long")


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "running_sum": lambda f, x, p, n, b: F.sum(_number(x)).over(f.window(*p).rowsBetween(Window.unboundedPreceding, 0)),
    "running_avg": lambda f, x, p, n, b: F.avg(_number(x)).over(f.window(*p).rowsBetween(Window.unboundedPreceding, 0)),
    "running_count": lambda f, x, p, n, b: F.count("*").over(f.window(*p).rowsBetween(Window.unboundedPreceding, 0)),
    "running_diff": lambda f, x, p, n, b: _number(x) - F.lag(_number(x)).over(f.window(*p)),
    "rank": lambda f, x, p, n, b: F.rank().over(_by_value(p, x.desc_nulls_last())).cast("long"),
    "dense_rank": lambda f, x, p, n, b: F.dense_rank().over(_by_value(p, x.desc_nulls_last())).cast("long"),
    "row_number": lambda f, x, p, n, b: F.row_number().over(f.window(*p)).cast("long"),
    "lag": lambda f, x, p, n, b: F.lag(x, n).over(f.window(*p)),
    "lead": lambda f, x, p, n, b: F.lead(x, n).over(f.window(*p)),
    "ntile": _ntile,
    "cume_dist": lambda f, x, p, n, b: F.round(F.cume_dist().over(_by_value(p, x.asc_nulls_first())), 6),
}


def _in_ranges(f: Frame, function: str, x: Column, alias: str, buckets: int) -> Frame:
    """A running function over all rows, from row numbers and totals of ranges of them."""
    at = hidden()
    span = hidden()
    f = f.numbered(at)
    value = hidden()
    df = f.df.withColumn(value, _number(x)).withColumn(span, F.floor((F.col(at) - 1) / 1_000_000))
    if function in ("row_number", "running_count"):
        return f.with_(df.withColumn(alias, F.col(at)).drop(at, span, value))
    if function == "ntile":
        total = f.df.count()
        return f.with_(df.withColumn(alias, _bucket(F.col(at) - 1, F.lit(total), buckets)).drop(at, span, value))
    totals = df.groupBy(span).agg(F.sum(value).alias("t"))
    base = hidden()
    before = totals.select(span, (F.coalesce(F.sum("t").over(Window.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias(base))
    own = F.sum(value).over(Window.partitionBy(span).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn(alias, own).join(before, span).withColumn(alias, F.col(alias) + F.col(base))
    if function == "running_avg":
        df = df.withColumn(alias, F.col(alias) / F.col(at))
    return f.with_(df.drop(at, span, value, base))


def _shifted(f: Frame, function: str, x: Column, alias: str, offset: int) -> Frame:
    """A value of another row, met by its number."""
    at, value, there = hidden(), hidden(), hidden()
    f = f.numbered(at)
    step = 1 if function == "running_diff" else -offset if function == "lead" else offset
    df = f.df.withColumn(value, _number(x) if function == "running_diff" else x)
    others = df.select((F.col(at) + step).alias(there), F.col(value).alias(alias))
    df = df.drop(alias).join(others, F.col(at) == F.col(there), "left")
    if function == "running_diff":
        df = df.withColumn(alias, F.col(value) - F.col(alias))
    return f.with_(df.drop(at, value, there))


def _ranked(f: Frame, function: str, x: Column, alias: str) -> Frame:
    """Ranks by value, from running totals of the counts of values."""
    value, n, key, out = hidden(), hidden(), hidden(), hidden()
    df = f.df.withColumn(value, x)
    counts = Frame(df.groupBy(F.col(value).alias(key)).agg(F.count("*").alias(n)), ((key, function == "cume_dist"),))
    if function == "dense_rank":
        ranks = counts.numbered(out).df
    else:
        ranks = _in_ranges(counts, "running_sum", F.col(n), out, 0).df
        total = F.lit(f.df.count())
        ranks = ranks.withColumn(out, (F.col(out) - F.col(n) + 1).cast("long") if function == "rank" else F.round(F.col(out) / total, 6))
    df = df.drop(alias).join(ranks.select(key, out), F.col(value).eqNullSafe(F.col(key))).withColumnRenamed(out, alias)
    return f.with_(df.drop(value, key))


def moving_average(frame: Frame, field: str, size: int, alias: str) -> Frame:
    """Mean of the last `size` rows, null until there are as many, to 6 digits.

    Over a large table the rows are cut into ranges of their numbers, each with the few rows before it.
    """
    if size < 1:
        raise ValueError("a moving average takes a window of at least 1")
    f = frame.ordered()
    step = f"moving_average({field}, window={size})"
    x = _number(f.value(field).col)
    at, span = hidden(), hidden()
    if f.large():
        f = f.numbered(at)
        n = max(1_000_000, size)
        home = F.floor((F.col(at) - 1) / n)
        # A row also goes to the next range if that range's first rows look back at it.
        copies = F.explode(F.when(F.col(at) > (home + 1) * n - (size - 1), F.array(home, home + 1)).otherwise(F.array(home)))
        df = f.df.withColumn(span, copies)
        mean = F.avg(x).over(Window.partitionBy(span).orderBy(at).rowsBetween(1 - size, 0))
        df = df.withColumn(alias, F.when(F.col(at) >= size, F.round(mean, 6))).where(F.col(span) == home).drop(at, span)
        return f.with_(df, step)
    mean = F.avg(x).over(f.window().rowsBetween(1 - size, 0))
    return f.with_(f.df.withColumn(alias, F.when(F.row_number().over(f.window()) >= size, F.round(mean, 6))), step)


def normalize(frame: Frame, field: str, alias: str) -> Frame:
    """From 0 at the least value to 1 at the greatest, to 6 digits; 0 if they are equal. One row of both is joined to all."""
    x = _number(frame.value(field).col)
    lo, hi = hidden(), hidden()
    ends = frame.df.agg(F.min(x).alias(lo), F.max(x).alias(hi))
    span = F.col(hi) - F.col(lo)
    scaled = F.when(span == 0, F.lit(0.0)).otherwise(F.round((x - F.col(lo)) / F.when(span != 0, span), 6))
    df = frame.df.crossJoin(F.broadcast(ends)).withColumn(alias, scaled).drop(lo, hi)
    return frame.with_(df, f"normalize({field})")
