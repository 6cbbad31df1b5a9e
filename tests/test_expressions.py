import pytest

from relspan import Engine, ExpressionError
from relspan.functions.syntax import parse

ROW = {"a": 3, "b": 2.5, "s": "  Hello ", "n": None, "flag": True, "xs": [1, 2, 3], "sub": {"k": "v"}, "zero": "0", "t": "12abc"}

CASES = [
    ("a + 2 * 3", 9), ("a -1", 2), ("(a + 1) * 2", 8), ("a / 2", 1.5), ("a % 2", 1), ("a ** 2", 9.0), ("-a", -3),
    ("a > 2 and b < 3", True), ("false or true and false", False), ("true or false and false", False), ("not a == 3", False), ("!(a == 3)", False),
    ("a in [1, 3]", True), ("s in ['x']", False), ("a > 2 ? 'y' : 'z'", "y"), ("s ~ n ~ a", "  Hello 3"),
    ("n == null", True), ("n != 5", True), ("n < 5", False), ("'3' == a", True), ("item['a']", 3), ("item.sub.k", "v"), ("sub['k']", "v"), ("xs[1]", 2),
    ("length(s)", 8), ("lower(s)", "  hello "), ("upper('x')", "X"), ("trim(s)", "Hello"), ("ltrim(s)", "Hello "), ("rtrim(s)", "  Hello"),
    ("abs(-2)", 2.0), ("round(2.345)", 2.35), ("round(2.5, 0)", 3.0), ("ceil(b)", 3.0), ("floor(b)", 2.0),
    ("contains(s, 'ell')", True), ("starts(trim(s), 'He')", True), ("ends(trim(s), 'lo')", True),
    ("substr('abcdef', 1, 2)", "bc"), ("substr('abcdef', -2)", "ef"), ("substr('abcdef', 1, -2)", "bcd"), ("replace('aXa', 'X', '-')", "a-a"),
    ("split('a.b.c', '.')[2]", "c"), ("join(split('a,b', ','), '+')", "a+b"), ("int(t)", 12), ("float('1.5x')", 1.5), ("int(n)", 0), ("str(flag)", "1"), ("str(4.0)", "4"),
    ("bool(zero)", False), ("count(xs)", 3), ("min(a, 1)", 1), ("max(a, null)", 3), ("isset(min(null, 5))", False), ("clamp(9, 1, 5)", 5),
    ("date('Y-m-d', 86400)", "1970-01-02"), ("isset(n)", False), ("empty(zero)", True), ("empty('false')", False),
]


def test_values(spark):
    p = Engine(spark).from_([ROW])
    got = p.select({f"c{i}": e for i, (e, _) in enumerate(CASES)}).collect()[0]
    wrong = [(e, got[f"c{i}"], want) for i, (e, want) in enumerate(CASES) if got[f"c{i}"] != want]
    assert not wrong


@pytest.mark.parametrize("bad", ["", "a +", "a == b == c", "a in b", "foo(1)", "missing", "round()", "[1,", "a ? b", "'open"])
def test_errors(spark, bad):
    with pytest.raises(ExpressionError):
        Engine(spark).from_([ROW]).select(bad)


def test_trees():
    assert parse("a or b and c") == ("binary", "and", ("binary", "or", ("field", "a"), ("field", "b")), ("field", "c"))
    assert parse("'a,b'") == ("value", "a,b")
    assert parse("x['a]b']") == ("get", ("field", "x"), ("value", "a]b"))


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).selectExpr("id", "cast(id as string) as s").write.parquet(path)
    plan = Engine(spark).from_(path, order_by="id").where("id > 3 and s == '5'").select({"id": "id"}).explain()
    assert "GreaterThan(id,3)" in plan and "EqualTo(s,5)" in plan and "Python" not in plan
