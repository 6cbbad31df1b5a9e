"""Values as the expression language sees them: truth, text and comparison of typed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, TEXT, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()


@dataclass(frozen=True)
class Typed:
    """A column and its type. `literal` tells that the column is a constant, `value` which."""

    col: Column
    type: T.DataType
    literal: bool = False
    value: object = None

    @property
    def number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def text(self) -> bool:
        return isinstance(self.type, T.StringType)


def literal(x: object) -> Typed:
    kind = NULL if x is None else BOOL if isinstance(x, bool) else LONG if isinstance(x, int) else DOUBLE if isinstance(x, float) else TEXT
    return Typed(F.lit(x) if kind != LONG else F.lit(x).cast("long"), kind, True, x)


def truth(x: Typed) -> Column:
    """Never null: false, zero, "", "0", null and empty arrays and maps are false."""
    t = x.type
    if isinstance(t, T.BooleanType):
        return F.coalesce(x.col, F.lit(False))
    if isinstance(t, T.NullType):
        return F.lit(False)
    if isinstance(t, T.NumericType):
        return F.coalesce(x.col != 0, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce((x.col != "") & (x.col != "0"), F.lit(False))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(x.col) > 0, F.lit(False))
    return x.col.isNotNull()


def text(x: Typed) -> Column:
    """Null is "", true "1", false "", and a whole double has no point."""
    t = x.type
    if isinstance(t, T.NullType):
        return F.lit("")
    if isinstance(t, T.BooleanType):
        return F.when(x.col, "1").otherwise("")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        whole = (x.col == F.floor(x.col)) & (F.abs(x.col) < 1e15)
        return F.coalesce(F.when(whole, x.col.cast("long").cast("string")).otherwise(x.col.cast("string")), F.lit(""))
    return F.coalesce(x.col.cast("string"), F.lit(""))


def number(x: Typed) -> Column:
    """A number, or the number that a text starts with, or 0."""
    t = x.type
    if isinstance(t, T.NumericType):
        return F.coalesce(x.col, F.lit(0).cast(t))
    if isinstance(t, T.BooleanType):
        return F.coalesce(x.col.cast("long"), F.lit(0).cast("long"))
    if isinstance(t, T.StringType):
        head = F.regexp_extract(x.col, r"^[ \t\n\r\x0B\f]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
        return F.coalesce(head.try_cast("double"), F.lit(0.0))
    if isinstance(t, T.NullType):
        return F.lit(0).cast("long")
    return x.col.cast("double")


def arithmetic(x: Typed) -> Typed:
    """An operand of + - * /: numbers and truth values as they are (null stays null), text by its value."""
    if x.number:
        return Typed(x.col, LONG if isinstance(x.type, T.IntegralType) else x.type, x.literal, x.value)
    if isinstance(x.type, T.BooleanType):
        return Typed(x.col.cast("long"), LONG)
    if isinstance(x.type, T.NullType):
        return Typed(F.lit(None).cast("double"), DOUBLE)
    return Typed(number(x), DOUBLE)


def compare(op: str, a: Typed, b: Typed) -> Column:
    """Two-valued: == holds for two nulls and != for one; orderings with a null are false."""
    left, right = a.col, b.col
    if NULL in (a.type, b.type):
        other = b if a.type == NULL else a
        empty = F.lit(True) if other.type == NULL else other.col.isNull()
        return empty if op == "==" else ~empty if op == "!=" else F.lit(False)
    if isinstance(a.type, T.BooleanType) != isinstance(b.type, T.BooleanType):
        left, right = truth(a), truth(b)
    elif a.text and b.number or a.number and b.text:
        # As numbers where the text is one, else as texts.
        words, figure = (a, b) if a.text else (b, a)
        value = words.col.try_cast("double")
        x, y = (value, figure.col.cast("double")) if a.text else (figure.col.cast("double"), value)
        as_number, as_text = _compare(op, x, y), _compare(op, a.col if a.text else text(a), b.col if b.text else text(b))
        return F.when(words.col.isNotNull() & value.isNull(), as_text).otherwise(as_number)
    if b.literal or a.literal:
        # A plain comparison is what Parquet filters take; only its null needs a value.
        plain = {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        return F.coalesce(plain, F.lit(op == "!="))
    return _compare(op, left, right)


def _compare(op: str, a: Column, b: Column) -> Column:
    if op == "==":
        return a.eqNullSafe(b)
    if op == "!=":
        return ~a.eqNullSafe(b)
    return F.coalesce({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], F.lit(False))
