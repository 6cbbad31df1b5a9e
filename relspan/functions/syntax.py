"""Text of an expression to a tree of tuples.

One regular expression cuts the text into tokens; a table of binding powers drives the parser. A tree is
("value", x), ("field", name), ("get", tree, key tree), ("list", [trees]), ("call", name, [trees]),
("unary", op, tree), ("binary", op, left, right) or ("choose", condition, then, otherwise).

Precedence, from loosest: a ? b : c (one, unless in parentheses); and, or (the same, left to right); one comparison;
"in [...]"; + - ~; * / % **; not, ! and - (tighter than comparisons: not a == b is (not a) == b).
"""

from __future__ import annotations

import re
from functools import lru_cache

TOKEN = re.compile(
    r"""\s*(?:
    (?P<float>\d+\.\d+) | (?P<int>\d+) |
    (?P<text>'(?:\\.|[^'\\])*' | "(?:\\.|[^"\\])*") |
    (?P<name>[A-Za-z_]\w*) |
    (?P<op>\*\*|==|!=|<=|>=|&&|\|\||[-+*/%~<>!?:()\[\],.])
    )""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"and": "and", "or": "or", "not": "not", "in": "in", "true": True, "false": False, "null": None}
#: Operator: binding power. Comparisons take no second operator of their level.
POWER = {"and": 10, "or": 10, "==": 20, "!=": 20, "<": 20, "<=": 20, ">": 20, ">=": 20, "in": 25, "+": 30, "-": 30, "~": 30, "*": 40, "/": 40, "%": 40, "**": 40}
SYNONYMS = {"&&": "and", "||": "or", "!": "not"}
UNARY = 50


class ExpressionError(ValueError):
    """An expression that cannot be read or compiled."""


def tokens(source: str) -> list[tuple[str, object]]:
    """(kind, value) pairs; kinds are value, name, op and end."""
    out, at = [], 0
    end = len(source.rstrip())
    while at < end:
        m = TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character {source[at:].lstrip()[:1]!r} in {source!r}")
        at, kind, raw = m.end(), m.lastgroup, m.group(m.lastgroup)
        if kind == "int":
            out.append(("value", int(raw)))
        elif kind == "float":
            out.append(("value", float(raw)))
        elif kind == "text":
            out.append(("value", re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), raw[1:-1], flags=re.S)))
        elif kind == "name" and raw.lower() in WORDS:
            word = WORDS[raw.lower()]
            out.append(("op", word) if isinstance(word, str) else ("value", word))
        elif kind == "name":
            out.append(("name", raw))
        else:
            out.append(("op", SYNONYMS.get(raw, raw)))
    return [*out, ("end", None)]


class _Parser:
    def __init__(self, source: str) -> None:
        self.source, self.tokens, self.at = source, tokens(source), 0

    def fail(self) -> ExpressionError:
        return ExpressionError(f"unexpected {self.tokens[self.at][1] or 'end'!r} in {self.source!r}")

    def peek(self, *ops: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind == "op" and value in ops

    def take(self, *ops: str) -> bool:
        hit = self.peek(*ops)
        self.at += hit
        return hit

    def expect(self, op: str) -> None:
        if not self.take(op):
            raise self.fail()

    def whole(self) -> tuple:
        tree = self.choice()
        if self.tokens[self.at][0] != "end":
            raise self.fail()
        return tree

    def choice(self) -> tuple:
        tree = self.level(0)
        if self.take("?"):
            then = self.level(0)
            self.expect(":")
            tree = ("choose", tree, then, self.level(0))
        return tree

    def level(self, least: int) -> tuple:
        left = self.operand()
        limit = 100
        while True:
            kind, op = self.tokens[self.at]
            power = POWER.get(op) if kind == "op" and isinstance(op, str) else None
            if power is None or power <= least or power >= limit:
                return left
            self.at += 1
            if op == "in":
                if not self.peek("["):
                    raise self.fail()
                left = ("binary", "in", left, self.operand())
            else:
                left = ("binary", op, left, self.level(power))
            if power == POWER["=="]:
                limit = power
            elif power < POWER["=="]:
                limit = 100

    def operand(self) -> tuple:
        if self.take("not"):
            return ("unary", "not", self.operand())
        if self.take("-"):
            return ("unary", "-", self.operand())
        return self.suffixes(self.atom())

    def atom(self) -> tuple:
        kind, value = self.tokens[self.at]
        if kind == "value":
            self.at += 1
            return ("value", value)
        if kind == "name":
            self.at += 1
            if self.take("("):
                return ("call", value, self.items(")"))
            return ("field", value)
        if self.take("("):
            tree = self.choice()
            self.expect(")")
            return tree
        if self.take("["):
            return ("list", self.items("]"))
        raise self.fail()

    def items(self, close: str) -> list[tuple]:
        out = []
        if not self.take(close):
            out.append(self.choice())
            while self.take(","):
                out.append(self.choice())
            self.expect(close)
        return out

    def suffixes(self, tree: tuple) -> tuple:
        while True:
            if self.take("."):
                kind, name = self.tokens[self.at]
                if kind != "name":
                    raise self.fail()
                self.at += 1
                tree = ("get", tree, ("value", name))
            elif tree[0] in ("field", "get", "call") and self.take("["):
                key = self.choice()
                self.expect("]")
                tree = ("get", tree, key)
            else:
                return tree


@lru_cache(maxsize=4096)
def parse(source: str) -> tuple:
    """The tree of an expression."""
    if not source.strip():
        raise ExpressionError("empty expression")
    return _Parser(source).whole()
