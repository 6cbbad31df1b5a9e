"""Filters, projections, sorts, slices and changes of shape."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions.semantics import text
from relspan.operators.sets import first_of, last_of
from relspan.plans.frame import Frame, hidden


def _label(x) -> str:
    return x if isinstance(x, str) else "function"


def where(frame: Frame, condition) -> Frame:
    return frame.with_(frame.df.where(frame.condition(condition)), f"where({_label(condition)})")


def select(frame: Frame, what) -> Frame:
    """One expression as column `value`, or a mapping of names to expressions."""
    named = what if isinstance(what, dict) else {"value": what}
    columns = [frame.value(e).col.alias(n) for n, e in named.items()]
    return frame.with_(frame.df.select(*columns, *[F.col(c) for c, _ in frame.order]), f"select({_label(what) if not isinstance(what, dict) else ', '.join(what)})")


def order_by(frame: Frame, keys, direction: str = "asc") -> Frame:
    """A stable sort: rows of equal keys stay in their order. A sort right after a sort takes the place of its keys."""
    pairs = [(keys, direction)] if isinstance(keys, str) else [(k, d) for k, d in keys]
    order, df = [], frame.df
    for key, way in pairs:
        name = hidden()
        order.append((name, way.lower() != "desc"))
        df = df.withColumn(name, frame.value(key).col)
    return frame.with_(df, f"order_by({', '.join(f'{k} {d}' for k, d in pairs)})", (*order, *frame.order))


def limit(frame: Frame, count: int, offset: int = 0) -> Frame:
    """`count` rows from `offset`; a negative offset counts from the end."""
    if count < 0:
        raise ValueError("a limit is at least 0")
    f = frame.ordered()
    step = f"limit({count}, offset={offset})"
    if offset < 0:
        back = [F.col(c).desc_nulls_last() if up else F.col(c).asc_nulls_first() for c, up in f.order]
        tail = f.with_(f.df.orderBy(*back).limit(-offset))
        return tail.with_(tail.df.orderBy(*tail.sort_keys).limit(count), step)
    df = f.df.orderBy(*f.sort_keys)
    return f.with_((df.offset(offset) if offset else df).limit(count), step)


def distinct(frame: Frame, key: str) -> Frame:
    one = first_of(frame, frame.value(key).col)
    return one.with_(one.df, f"distinct({key})")


def reindex(frame: Frame, key: str) -> Frame:
    """The last row of each key, at its first row's place, with the key as text in the first column, `key`."""
    one = last_of(frame, text(frame.value(key)))
    k = hidden()
    df = one.df.withColumn(k, text(one.value(key)))
    df = df.select(F.col(k).alias("_key"), *[F.col(f"`{c}`") for c in one.columns], *[F.col(c) for c, _ in one.order])
    return one.with_(df, f"reindex({key})")


def chunk(frame: Frame, size: int) -> Frame:
    """(chunk_id, rows): arrays of `size` rows, in order."""
    if size < 1:
        raise ValueError("a chunk has at least 1 row")
    at, spot = hidden(), hidden()
    f = frame.numbered(at)
    row = F.struct(F.col(at).alias("p"), F.struct(*[F.col(f"`{c}`") for c in f.columns]).alias("r"))
    df = f.df.groupBy(F.floor((F.col(at) - 1) / size).alias("chunk_id")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    return f.with_(df.withColumn(spot, F.col("chunk_id")), f"chunk({size})", ((spot, True),))


def fill_gaps(frame: Frame, key: str, series: list, default: dict) -> Frame:
    """A row for each item of `series`, in its order: the last row of that key, else `default` with the key. Other rows go."""
    spark = frame.df.sparkSession
    one = last_of(frame, frame.value(key).col)
    kind = frame.df.schema[key].dataType
    at, k = hidden(), hidden()
    steps = spark.createDataFrame([(i, v) for i, v in enumerate(series)], T.StructType([T.StructField(at, T.LongType()), T.StructField(k, kind)]))
    there = hidden()
    rows = one.df.select(*[F.col(f"`{c}`") for c in one.columns], F.lit(1).alias(there))
    joined = F.broadcast(steps).join(rows, F.col(k) == F.col(f"`{key}`"), "left")  # the series is a list of the caller's
    columns = []
    for c in one.columns:
        kept = F.col(f"`{c}`")
        if c == key:
            kept = F.col(k)
        elif c in default:
            kept = F.when(F.col(there).isNull(), F.lit(default[c]).cast(frame.df.schema[c].dataType)).otherwise(kept)
        columns.append(kept.alias(c))
    columns += [F.when(F.col(there).isNull(), F.lit(v)).alias(c) for c, v in default.items() if c not in one.columns]
    return one.with_(joined.select(*columns, F.col(at)), f"fill_gaps({key}, {len(series)} steps)", ((at, True),))


def transpose(frame: Frame) -> Frame:
    """(key, value): a row for each column, with its values as texts in the rows' order."""
    f, place = frame.place()
    at, spot = hidden(), hidden()
    names = f.columns
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(names)]))
    long = f.df.select(place.alias(at), cells.alias("c"))
    df = long.groupBy(F.col("c.i").alias(spot), F.col("c.key").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at).alias("p"), F.col("c.v").alias("v")))), lambda x: x["v"]).alias("value"))
    return f.with_(df, "transpose", ((spot, True),))


def sample(frame: Frame, count: int, seed: int | None) -> Frame:
    """Exactly `count` rows (all, if there are fewer), in their order; a seed picks the same rows again."""
    f = frame.ordered()
    if count <= 0:
        return f.with_(f.df.limit(0), f"sample({count})")
    spots = [F.col(c) for c, _ in f.order]
    pick = F.rand() if seed is None else F.xxhash64(F.lit(seed), *spots)
    return f.with_(f.df.orderBy(pick, *spots).limit(count), f"sample({count}" + (f", seed={seed})" if seed is not None else ")"))
