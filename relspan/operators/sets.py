"""Set operations by a key; only a union without one compares whole rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relspan.operators.joins import filtering_join, key_of
from relspan.plans.frame import Frame, hidden


def intersect(left: Frame, right: Frame, by: str, null_keys: str = "native") -> Frame:
    return filtering_join(left, right, by, by, "left_semi", null_keys, f"intersect(by={by})")


def except_(left: Frame, right: Frame, by: str, null_keys: str = "native") -> Frame:
    return filtering_join(left, right, by, by, "left_anti", null_keys, f"except(by={by})")


def concat(left: Frame, right: Frame) -> Frame:
    """Left rows, then right rows, each in its order."""
    side = hidden()
    l, r = left.ordered(), right.ordered()
    theirs = tuple((hidden(), up) for _, up in r.order)
    rows = r.df.select(*[F.col(f"`{c}`") for c in r.columns], *[F.col(c).alias(n) for (c, _), (n, _) in zip(r.order, theirs, strict=True)], F.lit(1).alias(side))
    df = l.df.select(*[F.col(f"`{c}`") for c in l.columns], *[F.col(c) for c, _ in l.order], F.lit(0).alias(side)).unionByName(rows, allowMissingColumns=True)
    return left.with_(df, order=((side, True), *l.order, *theirs))


def first_of(frame: Frame, *keys: Column) -> Frame:
    """The first row of each key; Spark cuts each task's rows of a key to one ahead of the shuffle."""
    f = frame.ordered()
    n = hidden()
    return f.with_(f.df.withColumn(n, F.row_number().over(f.window(*keys))).where(F.col(n) == 1).drop(n))


def last_of(frame: Frame, key: Column) -> Frame:
    """The last row of each key, at the place of its first row; tasks keep a row a key each ahead of the shuffle."""
    f, place = frame.place()
    k, spot, row = hidden(), hidden(), hidden()
    columns = [F.col(f"`{c}`") for c in f.columns]
    df = f.df.groupBy(key.alias(k)).agg(F.max_by(F.struct(*columns), place).alias(row), F.min(place).alias(spot))
    return f.with_(df.select(*[F.col(row)[c].alias(c) for c in f.columns], spot), order=((spot, True),))


def union(left: Frame, right: Frame, by: str | None, null_keys: str = "native") -> Frame:
    both = concat(left, right)
    keys = [key_of(both, by, null_keys).col] if by else [F.col(f"`{c}`") for c in both.columns]
    one = first_of(both, *keys)
    return one.with_(one.df, f"union(by={by})")


def symmetric_diff(left: Frame, right: Frame, by: str, null_keys: str = "native") -> Frame:
    l, r = (last_of(f, key_of(f, by, null_keys).col) for f in (left, right))
    a = filtering_join(l, r, by, by, "left_anti", null_keys, "-")
    b = filtering_join(r, l, by, by, "left_anti", null_keys, "-")
    out = concat(a, b)
    return left.with_(out.df, f"symmetric_diff(by={by})", out.order)
