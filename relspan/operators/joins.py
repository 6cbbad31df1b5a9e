"""Joins on one key of each side, cross and positional joins.

Keys are compared as they are, so that Spark can broadcast, sort or hash; with null_keys="match" they are compared as
texts in which null, "" and false are equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relspan.functions.semantics import Typed, text
from relspan.plans.frame import Frame, hidden


def parse_on(on: str) -> tuple[str, str]:
    left, eq, right = on.partition("=")
    if not eq or not left.strip() or not right.strip():
        raise ValueError(f'a join takes "left=right", not {on!r}')
    return left.strip(), right.strip()


def key_of(frame: Frame, key: str, null_keys: str) -> Typed:
    x = frame.value(key)
    return Typed(text(x), x.type) if null_keys == "match" else x


def _keyed(frame: Frame, key: str, null_keys: str) -> tuple[Frame, str]:
    name = hidden()
    return frame.with_(frame.df.withColumn(name, key_of(frame, key, null_keys).col)), name


def _nested(right: Frame, key: str, alias: str, null_keys: str) -> tuple[Frame, str]:
    """The right side as one struct, with its key and order."""
    name, order = hidden(), [(hidden(), up) for _, up in right.order]
    value, row = key_of(right, key, null_keys).col.alias(name), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias(alias)
    df = right.df.select(value, row, *[F.col(c).alias(n) for (c, _), (n, _) in zip(right.order, order, strict=True)])
    return Frame(df, tuple(order)), name


def nested_join(left: Frame, right: Frame, left_key: str, right_key: str, alias: str, how: str, null_keys: str = "native") -> Frame:
    """Each left row with each right row of its key, nested under alias; left rows first, then the right side's order."""
    lk = hidden()
    kept = [c for c in left.columns if c != alias]
    mine = left.df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(c) for c, _ in left.order], key_of(left, left_key, null_keys).col.alias(lk))
    r, rk = _nested(right, right_key, alias, null_keys)
    df = mine.join(r.df, F.col(lk) == F.col(rk), how)
    df = df.select(*[F.col(f"`{c}`") for c in [*kept, alias]], *[F.col(c) for c, _ in (*left.order, *r.order)])
    return left.with_(df, f"{how}_join(on={left_key}={right_key}, as={alias})", (*left.order, *r.order))


def filtering_join(left: Frame, right: Frame, left_key: str, right_key: str, how: str, null_keys: str = "native", step: str | None = None) -> Frame:
    """Left rows that have (left_semi), or have not (left_anti), a right row of their key."""
    l, lk = _keyed(left, left_key, null_keys)
    rk = hidden()
    keys = right.df.select(key_of(right, right_key, null_keys).col.alias(rk))
    return left.with_(l.df.join(keys, F.col(lk) == F.col(rk), how).drop(lk), step or f"{how}_join(on={left_key}={right_key})")


def _merge(left: Frame, right: Frame, left_prefix: str, right_prefix: str) -> tuple[list[Column], list[Column], Frame, tuple]:
    """Columns of both sides under prefixes; of two of one name the right one stays."""
    names = {f"{right_prefix}{c}" for c in right.columns}
    mine = [F.col(f"`{c}`").alias(f"{left_prefix}{c}") for c in left.columns if f"{left_prefix}{c}" not in names]
    order = tuple((hidden(), up) for _, up in right.order)
    theirs = [F.col(f"`{c}`").alias(f"{right_prefix}{c}") for c in right.columns]
    theirs += [F.col(c).alias(n) for (c, _), (n, _) in zip(right.order, order, strict=True)]
    return mine, theirs, right, order


def cross_join(left: Frame, right: Frame, left_prefix: str = "", right_prefix: str = "") -> Frame:
    mine, theirs, right, order = _merge(left, right, left_prefix, right_prefix)
    df = left.df.select(*mine, *[F.col(c) for c, _ in left.order]).crossJoin(right.df.select(*theirs))
    return left.with_(df, "cross_join", left.order + order)


def zip_rows(left: Frame, right: Frame, left_as: str = "", right_as: str = "") -> Frame:
    """Rows of the same place in both; as many as the shorter side has."""
    at = hidden()
    l, r = left.numbered(at), right.numbered(at)
    mine, theirs, r, _ = _merge(l, r, left_as, right_as)
    theirs = theirs[: len(r.columns)]
    df = l.df.select(*mine, F.col(at)).join(r.df.select(*theirs, F.col(at)), at)
    return left.with_(df, "zip", ((at, True),))
