"""Expressions to Spark columns, once for a pipeline step, with the types of its fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions.semantics import BOOL, DOUBLE, LONG, NULL, TEXT, Typed, arithmetic, compare, literal, number, text, truth
from relspan.functions.syntax import ExpressionError, parse

BLANK = " \t\n\r\x00\x0b"
#: Letters of a date format and Spark's patterns for them.
DATE_LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "n": "M", "d": "dd", "j": "d", "H": "HH", "G": "H", "h": "hh", "g": "h", "i": "mm", "s": "ss", "D": "EEE", "l": "EEEE", "M": "MMM", "F": "MMMM", "A": "a"}


def _s(x: Typed) -> Column:
    return text(x)


def _d(x: Typed) -> Column:
    return number(x).cast("double")


def _length(x: Typed) -> Typed:
    if isinstance(x.type, (T.ArrayType, T.MapType)):
        return Typed(F.coalesce(F.size(x.col), F.lit(0)).cast("long"), LONG)
    return Typed(F.octet_length(_s(x)).cast("long"), LONG)


def _substr(s: Typed, start: Typed, length: Typed | None = None) -> Typed:
    """0-based characters; a negative start counts from the end, a negative length leaves out the tail."""
    base, n = _s(s), F.char_length(_s(s))
    at = number(start).cast("int")
    at = F.when(at < 0, F.greatest(n + at, F.lit(0))).otherwise(F.least(at, n))
    if length is None or length.type == NULL:
        size = n
    else:
        want = number(length).cast("int")
        size = F.when(want < 0, F.greatest(n + want - at, F.lit(0))).otherwise(want)
    return Typed(F.substring(base, at + 1, size), TEXT)


def _int(x: Typed) -> Typed:
    if isinstance(x.type, T.IntegralType):
        return Typed(F.coalesce(x.col.cast("long"), F.lit(0).cast("long")), LONG)
    return Typed(F.coalesce(number(x).try_cast("long"), F.lit(0).cast("long")), LONG)


def _split(s: Typed, sep: Typed) -> Typed:
    if not sep.literal or not sep.value:
        raise ExpressionError("split takes a separator that is a text of at least one character")
    return Typed(F.split(_s(s), "\\Q" + str(sep.value).replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), T.ArrayType(TEXT))


def _least(a: Typed, b: Typed, pick: Callable, null_wins: bool) -> Typed:
    """Null is the lowest of all values."""
    if NULL in (a.type, b.type):
        return Typed(F.lit(None), NULL) if null_wins else (b if a.type == NULL else a)
    kind = a.type if a.type == b.type else DOUBLE if a.number and b.number else TEXT
    x, y = (v.col if v.type == kind else v.col.cast(kind) if kind == DOUBLE else _s(v) for v in (a, b))
    out = pick(x, y)
    return Typed(F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(out) if null_wins else out, kind)


def _low(a: Typed, b: Typed) -> Typed:
    return _least(a, b, F.least, True)


def _high(a: Typed, b: Typed) -> Typed:
    return _least(a, b, F.greatest, False)


def _date(form: Typed, at: Typed | None = None) -> Typed:
    if not form.literal:
        raise ExpressionError("date takes a format that is a text")
    pattern = "".join(DATE_LETTERS.get(c) or ("'" + c + "'" if c.isalpha() else "''" if c == "'" else c) for c in str(form.value))
    if at is None:
        when = F.current_timestamp()
    elif isinstance(at.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        when = at.col.cast("timestamp_ntz")
    else:
        when = F.timestamp_seconds(number(at).cast("long"))
    # The weekday's number, 1 to 7 from Monday, has no pattern.
    if "N" in str(form.value):
        day = (F.weekday(when) + 1).cast("string")
        parts = [x for i, part in enumerate(str(form.value).split("N")) for x in ([day] if i else []) + ([_date(literal(part), at).col] if part else [])]
        return Typed(F.concat(*parts), TEXT)
    return Typed(F.date_format(when, pattern), TEXT)


#: Name: least and most arguments, and the function.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Typed]]] = {
    "length": (1, 1, _length),
    "lower": (1, 1, lambda s: Typed(F.lower(_s(s)), TEXT)),
    "upper": (1, 1, lambda s: Typed(F.upper(_s(s)), TEXT)),
    "trim": (1, 1, lambda s: Typed(F.btrim(_s(s), F.lit(BLANK)), TEXT)),
    "ltrim": (1, 1, lambda s: Typed(F.ltrim(_s(s), F.lit(BLANK)), TEXT)),
    "rtrim": (1, 1, lambda s: Typed(F.rtrim(_s(s), F.lit(BLANK)), TEXT)),
    "abs": (1, 1, lambda x: Typed(F.abs(_d(x)), DOUBLE)),
    "round": (1, 2, lambda x, p=None: Typed(F.round(_d(x), 2 if p is None else int(p.value)), DOUBLE)),
    "ceil": (1, 1, lambda x: Typed(F.ceil(_d(x)).cast("double"), DOUBLE)),
    "floor": (1, 1, lambda x: Typed(F.floor(_d(x)).cast("double"), DOUBLE)),
    "contains": (2, 2, lambda s, t: Typed(F.contains(_s(s), _s(t)), BOOL)),
    "starts": (2, 2, lambda s, t: Typed(F.startswith(_s(s), _s(t)), BOOL)),
    "ends": (2, 2, lambda s, t: Typed(F.endswith(_s(s), _s(t)), BOOL)),
    "substr": (2, 3, _substr),
    "replace": (3, 3, lambda s, a, b: Typed(F.replace(_s(s), _s(a), _s(b)), TEXT)),
    "split": (2, 2, _split),
    "join": (2, 2, lambda xs, sep: Typed(F.array_join(F.transform(xs.col, lambda v: F.coalesce(v.cast("string"), F.lit(""))), sep.value), TEXT)),
    "int": (1, 1, _int),
    "float": (1, 1, lambda x: Typed(_d(x), DOUBLE)),
    "str": (1, 1, lambda x: Typed(_s(x), TEXT)),
    "bool": (1, 1, lambda x: Typed(truth(x), BOOL)),
    "count": (1, 1, lambda x: _length(x) if isinstance(x.type, (T.ArrayType, T.MapType)) else literal(0)),
    "min": (2, 2, _low),
    "max": (2, 2, _high),
    "clamp": (3, 3, lambda v, lo, hi: _low(_high(v, lo), hi)),
    "date": (1, 2, _date),
    "now": (0, 0, lambda: Typed(F.unix_timestamp(), LONG)),
    "isset": (1, 1, lambda x: Typed(x.col.isNotNull(), BOOL)),
    "empty": (1, 1, lambda x: Typed(~truth(x), BOOL)),
}


class Compiler:
    """Compiles trees against the fields of a schema."""

    def __init__(self, schema: T.StructType, missing: str = "error") -> None:
        self.fields = {f.name: f.dataType for f in schema.fields}
        self.missing = missing

    def compile(self, source: str) -> Typed:
        return self.tree(parse(source))

    def condition(self, source: str) -> Column:
        """A filter: true where the expression is true. Comparisons stay plain, so that sources can take them over."""
        return self._filter(parse(source))

    def _filter(self, node: tuple) -> Column:
        if node[0] == "binary" and node[1] in ("and", "or"):
            a, b = self._filter(node[2]), self._filter(node[3])
            return a & b if node[1] == "and" else a | b
        if node[0] == "binary" and node[1] in ("==", "!=", "<", "<=", ">", ">="):
            a, b = self.tree(node[2]), self.tree(node[3])
            alike = a.text and b.text or a.number and b.number
            if alike and (a.literal or b.literal):
                of = b if a.literal else a
                plain = {"==": a.col == b.col, "!=": (a.col != b.col) | of.col.isNull(), "<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}
                return plain[node[1]]
        if node[0] == "binary" and node[1] == "in" and node[3][0] == "list":
            x, items = self.tree(node[2]), [self.tree(i) for i in node[3][1]]
            if items and all(i.literal and (i.text and x.text or i.number and x.number) for i in items):
                return x.col.isin([i.value for i in items])
        return truth(self.tree(node))

    def tree(self, node: tuple) -> Typed:
        return getattr(self, f"_{node[0]}")(*node[1:])

    def _value(self, x: object) -> Typed:
        return literal(x)

    def _field(self, name: str) -> Typed:
        if name in self.fields:
            return Typed(F.col(f"`{name}`"), self.fields[name])
        if self.missing == "null":
            return literal(None)
        raise ExpressionError(f"no field {name!r}; there are {', '.join(sorted(self.fields))}")

    def _get(self, base: tuple, key: tuple) -> Typed:
        if base == ("field", "item") and "item" not in self.fields and key[0] == "value" and isinstance(key[1], str):
            return self._field(key[1])
        of, at = self.tree(base), self.tree(key)
        if isinstance(of.type, T.StructType) and at.literal:
            kinds = {f.name: f.dataType for f in of.type.fields}
            if at.value in kinds:
                return Typed(of.col.getField(str(at.value)), kinds[at.value])
            if self.missing == "null":
                return literal(None)
            raise ExpressionError(f"no field {at.value!r} in {', '.join(kinds)}")
        if isinstance(of.type, T.ArrayType):
            return Typed(F.get(of.col, number(at).cast("int")), of.type.elementType)
        if isinstance(of.type, T.MapType):
            return Typed(F.try_element_at(of.col, at.col), of.type.valueType)
        if of.type == NULL:
            return literal(None)
        raise ExpressionError(f"{of.type.simpleString()} has no fields")

    def _list(self, items: list[tuple]) -> Typed:
        parts = [self.tree(i) for i in items]
        kinds = {p.type for p in parts if p.type != NULL}
        kind = TEXT if not kinds else kinds.pop() if len(kinds) == 1 else DOUBLE if all(p.number or p.type == NULL for p in parts) else TEXT
        return Typed(F.array(*[p.col.cast(kind) if p.type != kind else p.col for p in parts]) if parts else F.array().cast("array<string>"), T.ArrayType(kind))

    def _call(self, name: str, args: list[tuple]) -> Typed:
        if name not in FUNCTIONS:
            raise ExpressionError(f"no function {name!r}; there are {', '.join(FUNCTIONS)}")
        least, most, function = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise ExpressionError(f"{name} takes {least}{f' to {most}' if most > least else ''} arguments, not {len(args)}")
        return function(*[self.tree(a) for a in args])

    def _unary(self, op: str, of: tuple) -> Typed:
        x = self.tree(of)
        if op == "not":
            return Typed(~truth(x), BOOL)
        if x.literal and x.number:
            return literal(-x.value)
        x = arithmetic(x)
        return Typed(-x.col, x.type)

    def _choose(self, condition: tuple, then: tuple, otherwise: tuple) -> Typed:
        c, a, b = self.tree(condition), self.tree(then), self.tree(otherwise)
        kind = a.type if a.type == b.type or b.type == NULL else b.type if a.type == NULL else DOUBLE if a.number and b.number else TEXT
        x, y = (v.col if v.type in (kind, NULL) else v.col.cast(kind) if kind == DOUBLE else text(v) for v in (a, b))
        return Typed(F.when(truth(c), x).otherwise(y), kind)

    def _binary(self, op: str, left: tuple, right: tuple) -> Typed:
        if op == "in":
            if right[0] != "list":
                raise ExpressionError("in takes a list")
            return self._within(self.tree(left), [self.tree(i) for i in right[1]])
        a, b = self.tree(left), self.tree(right)
        if op in ("and", "or"):
            x, y = truth(a), truth(b)
            return Typed(x & y if op == "and" else x | y, BOOL)
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return Typed(compare(op, a, b), BOOL)
        if op == "~":
            return Typed(F.concat(text(a), text(b)), TEXT)
        if op == "%":
            return Typed(number(a).cast("long") % number(b).cast("long"), LONG)
        x, y = arithmetic(a), arithmetic(b)
        whole = isinstance(x.type, T.IntegralType) and isinstance(y.type, T.IntegralType)
        if op == "/":
            return Typed(x.col.cast("double") / y.col.cast("double"), DOUBLE)
        if op == "**":
            return Typed(F.pow(x.col, y.col), DOUBLE)
        l, r = (x.col.cast("long"), y.col.cast("long")) if whole else (x.col.cast("double"), y.col.cast("double"))
        return Typed({"+": l + r, "-": l - r, "*": l * r}[op], LONG if whole else DOUBLE)

    def _within(self, x: Typed, items: list[Typed]) -> Typed:
        plain = [i for i in items if i.literal and i.type != NULL and (i.text and x.text or i.number and x.number)]
        out = F.coalesce(x.col.isin([i.value for i in plain]), F.lit(False)) if plain else F.lit(False)
        for i in items:
            if not any(i is p for p in plain):
                out = out | compare("==", x, i)
        return Typed(out, BOOL)
