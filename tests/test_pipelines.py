import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from relspan import Engine

USERS = [{"id": 1, "name": "Ann", "tier": "vip"}, {"id": 2, "name": "Bob", "tier": "standard"}, {"id": 3, "name": "Cyd", "tier": "vip"}]
ORDERS = [
    {"id": 1, "userId": 1, "status": "paid", "amount": 500, "month": "Jan"},
    {"id": 2, "userId": 2, "status": "pending", "amount": 120, "month": "Jan"},
    {"id": 3, "userId": 1, "status": "paid", "amount": 300, "month": "Feb"},
    {"id": 4, "userId": 3, "status": "paid", "amount": 800, "month": "Mar"},
    {"id": 5, "userId": 9, "status": "cancelled", "amount": 50, "month": "Mar"},
]


@pytest.fixture(scope="module")
def e(spark):
    return Engine(spark)


def col(p, name):
    return [r[name] for r in p.collect()]


def ids(*xs):
    return [{"id": x, "n": i} for i, x in enumerate(xs)]


def test_filters_and_partition(e):
    p = e.from_(ORDERS).where("status == 'paid'")
    assert col(p, "id") == [1, 3, 4]
    part = p.partition("amount > 400")
    assert (part.pass_count, part.fail_count, part.total_count) == (2, 1, 3)
    assert col(part.passed, "id") == [1, 4] and col(part.failed, "id") == [3]
    assert e.from_(ORDERS).where("id > 99").partition("id > 0").pass_rate == 0.0
    assert col(e.from_(ORDERS).pluck("status"), "value")[:2] == ["paid", "pending"]
    assert col(e.from_(ORDERS).where(lambda df: df.amount > 400), "id") == [1, 4]


def test_joins(e):
    o = e.from_(ORDERS)
    inner = o.inner_join(USERS, "userId", "id", "owner")
    assert [(r["id"], r["owner"]["name"]) for r in inner.collect()] == [(1, "Ann"), (2, "Bob"), (3, "Ann"), (4, "Cyd")]
    assert col(inner.where("owner.tier == 'vip'"), "id") == [1, 3, 4]
    left = o.left_join(USERS, "userId=id", "owner").collect()
    assert left[4]["owner"] is None and len(left) == 5
    assert col(o.semi_join(USERS, "userId", "id"), "id") == [1, 2, 3, 4]
    assert col(o.anti_join(USERS, "userId", "id"), "id") == [5]
    assert len(e.from_(USERS).cross_join(USERS, "l_", "r_").collect()) == 9
    z = e.from_([{"a": 1}, {"a": 2}]).zip([{"b": 3}, {"b": 4}, {"b": 5}])
    assert [(r["a"], r["b"]) for r in z.collect()] == [(1, 3), (2, 4)]
    with pytest.raises(ValueError):
        o.left_join(USERS, "userId")
    nulls = e.from_([{"k": None, "x": 1}, {"k": "a", "x": 2}])
    assert col(nulls.semi_join([{"k": ""}], "k", "k", null_keys="match"), "x") == [1]
    assert col(nulls.semi_join([{"k": ""}], "k", "k"), "x") == []


def test_sets(e):
    assert col(e.from_(ids(1, 2, 3)).intersect(ids(2, 3)), "id") == [2, 3]
    assert col(e.from_(ids(1, 2, 3)).except_(ids(2)), "id") == [1, 3]
    assert col(e.from_(ids(1, 2, 1)).union(ids(2, 3), by="id"), "id") == [1, 2, 3]
    assert col(e.from_([{"x": 2}, {"x": 1}, {"x": 2}]).union([{"x": 3}]), "x") == [2, 1, 3]
    assert col(e.from_(ids(1, 2)).symmetric_diff(ids(2, 3)), "id") == [1, 3]
    twice = e.from_(ids(5, 7, 5)).symmetric_diff(ids(7)).collect()
    assert [(r["id"], r["n"]) for r in twice] == [(5, 2)]


def test_aggregates(e):
    vals = e.from_([{"x": v, "s": s} for v, s in zip([2, 4, 4, 4, 5, 5, 7, 9], "abacbbac", strict=True)])
    r = vals.aggregate({"sd": "stddev(x)", "va": "variance(x)", "med": "median(x)", "n": "count(*)", "sum": "sum(x)", "m": "mode(s)", "f": "first(x)", "l": "last(x)", "cat": 'string_agg(s, "-")', "d": "count_distinct(s)", "q": "ntile(x)", "c": "cume_dist(x)", "p": "percentile(x, 0.9)", "every": "bool_and(x > 1)", "some": "bool_or(x > 8)"}).collect()[0]
    assert r["sd"] == pytest.approx(2.138089935299395) and r["va"] == pytest.approx(4.571428571428571)
    assert (r["_group"], r["med"], r["n"], r["sum"], r["m"], r["f"], r["l"], r["d"]) == ("*", 4.5, 8, 40, "a", 2, 9, 3)
    assert r["cat"] == "a-b-a-c-b-b-a-c" and r["q"] == [4, 4, 5] and r["c"][4] == 0.5 and r["p"] == 9 and r["every"] and r["some"]
    g = e.from_(ORDERS).where("status == 'paid'").group_by("userId").aggregate({"total": "sum(amount)"}).collect()
    assert [(x["_group"], x["total"]) for x in g] == [("1", 800), ("3", 800)]
    none = e.from_(ORDERS).where("id > 99")
    assert none.group_by("status").aggregate({"n": "count(*)"}).collect() == []
    flat = none.aggregate({"n": "count(*)", "s": "sum(amount)", "a": "avg(amount)"}).collect()[0]
    assert (flat["n"], flat["s"], flat["a"]) == (0, 0, None)
    assert e.from_(ORDERS).tally("status").to_dict() == {"paid": 3, "pending": 1, "cancelled": 1}
    assert list(e.from_(ORDERS).group_by("month").to_dict()) == ["Jan", "Feb", "Mar"]
    for bad in ("nope(x)", "sum", "percentile(x, 2)", "sum()"):
        with pytest.raises(ValueError):
            vals.aggregate({"v": bad})
    assert e.from_([{"x": v} for v in (1, 2, 2, 1)]).aggregate({"m": "mode(x)"}).collect()[0]["m"] == 1


def test_custom_aggregates(spark):
    from pyspark.sql import functions as F

    e = Engine(spark)
    e.aggregates.register("range", lambda x: F.max(x.col) - F.min(x.col))
    e.aggregates.register_python("geomean", lambda s: float(s.prod() ** (1 / len(s))), "double")
    r = e.from_([{"x": 2.0}, {"x": 8.0}]).aggregate({"r": "range(x)"}).collect()[0]
    assert r["r"] == 6.0
    assert e.aggregates.has("geomean") and not Engine(spark).aggregates.has("geomean")


def test_windows(e):
    p = e.from_([{"u": u, "x": x} for u, x in (("a", 100), ("b", 200), ("a", 50), ("b", 50), ("a", 50), ("b", 7))])
    w = lambda fn, **k: col(p.window(fn, "x", as_="w", **k), "w")
    assert w("running_sum", partition_by="u") == [100, 200, 150, 250, 200, 257]
    assert w("running_diff") == [None, 100, -150, 0, 0, -43]
    assert w("rank") == [2, 1, 3, 3, 3, 6] and w("dense_rank") == [2, 1, 3, 3, 3, 4]
    assert w("lag", offset=2) == [None, None, 100, 200, 50, 50] and w("lead") == [200, 50, 50, 50, 7, None]
    assert w("ntile", buckets=4) == [1, 1, 2, 3, 3, 4] and w("running_count") == [1, 2, 3, 4, 5, 6]
    assert w("cume_dist") == [0.833333, 1.0, 0.666667, 0.666667, 0.666667, 0.166667]
    assert col(e.from_([{"x": v} for v in (100, 200, 300, 400)]).moving_average("x", 3), "moving_avg") == [None, None, 200, 300]
    assert col(e.from_([{"x": v} for v in (100, 200, 300)]).normalize("x"), "normalized") == [0, 0.5, 1]
    assert col(e.from_([{"x": 5}, {"x": 5}]).normalize("x"), "normalized") == [0, 0]
    assert col(p.rank_by("x"), "x") == [200, 100, 50, 50, 50, 7]
    with pytest.raises(ValueError):
        p.window("nope")
    with pytest.raises(ValueError):
        p.moving_average("x", 0)


def test_ranges_of_a_large_table_agree(e, monkeypatch):
    from relspan.operators.windows import FUNCTIONS
    from relspan.plans.frame import Frame

    p = e.from_([{"x": None if i == 7 else (i * 37) % 101, "s": f"é{(i * 53) % 97}", "g": i % 3} for i in range(300)])

    def everything():
        specs = {"m": "median(x)", "p": "percentile(x, 0.9)", "q": "percentile(x, 0)", "n": "count(*)"}
        yield [tuple(r) for r in p.group_by("g").aggregate(specs).collect()]
        yield [tuple(r) for r in p.aggregate(specs).collect()]
        yield col(p.moving_average("x", 5), "moving_avg")
        for order, functions in ((p, FUNCTIONS), (p.order_by("s", "desc"), ("row_number", "lag")), (p.order_by("x"), ("running_sum", "lead"))):
            for f in functions:
                yield f, [(r["x"], r["s"], r["w"]) for r in order.window(f, "x", as_="w", offset=2).collect()]

    small = list(everything())
    monkeypatch.setattr(Frame, "large", lambda self: True)
    assert small == list(everything())


def test_plans(e, spark):
    """Plain groups are aggregated by hash, and copies of a key go ahead of the shuffle."""
    from pyspark.sql import functions as F

    p = e.from_(spark.range(100).withColumn("k", F.col("id") % 7), order_by="id")
    plan = lambda q: q.df._jdf.queryExecution().executedPlan().toString()
    for q in (p, p.order_by("id", "desc")):
        grouped = plan(q.group_by("k").aggregate({"n": "count(*)", "s": "sum(id)"}))
        assert "HashAggregate" in grouped and "SortAggregate" not in grouped
    assert "WindowGroupLimit" in plan(p.distinct("k")) and "partial_max_by" in plan(p.reindex("k"))


def test_names_like_ours(e, spark):
    """No column of a user's is taken for one of ours."""
    names = ["__order", "__place", "__before", "__o1", "__lo", "__c", "__k", "__r", "value", "n", "p"]
    rows = [dict.fromkeys(names, i % 3) | {"id": i} for i in range(6)]
    for p in (e.from_(rows), e.from_(spark.createDataFrame(rows), order_by="id")):
        assert set(p.collect()[0].asDict()) == {*names, "id"}
        assert col(p.normalize("__lo").window("running_sum", "__before", as_="w"), "w") == [0, 1, 3, 3, 4, 6]
        assert col(p.reindex("__place"), "__k") == [0, 1, 2] and col(p.distinct("__c"), "id") == [0, 1, 2]
        assert [r["1"] for r in p.pivot("__r", "__c", "n", "sum").collect()] == [None, 2, None]
        assert p.group_by("__k").aggregate({"m": "mode(__r)", "c": "cume_dist(n)", "d": "median(p)"}).collect()[2]["m"] == 2


def test_shapes(e):
    o = e.from_(ORDERS)
    assert col(o.order_by("amount", "DESC"), "id") == [4, 1, 3, 2, 5]
    assert col(o.order_by([["status", "asc"], ["amount", "desc"]]), "id") == [5, 4, 1, 3, 2]
    assert col(o.limit(2, 1), "id") == [2, 3] and col(o.limit(1, -2), "id") == [4] and col(o.top_n(2, "amount"), "id") == [4, 1] and col(o.bottom_n(1, "amount"), "id") == [5]
    assert col(o.distinct("status"), "id") == [1, 2, 5]
    assert o.reindex("status").to_dict()["paid"]["id"] == 4
    assert [len(r["rows"]) for r in o.chunk(2).collect()] == [2, 2, 1]
    gaps = e.from_([{"m": "Jan", "v": 1}, {"m": "Mar", "v": 3}]).fill_gaps("m", ["Jan", "Feb", "Mar"], {"v": 0})
    assert [(r["m"], r["v"]) for r in gaps.collect()] == [("Jan", 1), ("Feb", 0), ("Mar", 3)]
    assert e.from_([{"month": "Jan", "rev": 10}, {"month": "Feb", "rev": 12}]).transpose().to_dict() == {"month": ["Jan", "Feb"], "rev": ["10", "12"]}
    s = o.sample(3, seed=7)
    assert col(s, "id") == col(o.sample(3, seed=7), "id") == sorted(col(s, "id")) and len(s.collect()) == 3 and o.sample(0).collect() == []
    cells = {r["_row"]: r.asDict() for r in o.pivot("userId", "status", "amount").collect()}
    assert cells["1"]["paid"] == 800 and cells["1"]["pending"] is None
    for bad in (lambda: o.limit(-1), lambda: o.chunk(0)):
        with pytest.raises(ValueError):
            bad()


def test_engine(e, spark, tmp_path):
    assert col(e.from_({"x": i} for i in range(3)), "x") == [0, 1, 2]
    assert col(e.from_(lambda: [1, 2]), "value") == [1, 2]
    assert e.parallel({"a": e.from_(ORDERS), "b": lambda: e.from_(USERS)})["b"][0]["name"] == "Ann"
    m = e.from_(ORDERS).where("id > 1").materialize()
    assert m.first()["id"] == 2 and m.last()["id"] == 5 and not m.is_empty() and m.execution_log[0]["operation"] == "where"
    log = e.from_(ORDERS).where("id > 1").group_by("status").aggregate({"n": "count(*)"}).limit(2).materialize().execution_log
    assert [(x["operation"], x["input_rows"], x["output_rows"]) for x in log] == [("where", 5, 4), ("group_by", 4, 4), ("aggregate", 4, 3), ("limit", 3, 2)] and all(x["duration_ms"] >= 0 for x in log)
    assert e.from_(ORDERS).where("id > 1").source().count() == 5
    assert [s.split("(")[0] for s in e.from_(ORDERS).where("id > 1").limit(2).operations()] == ["where", "limit"]
    for kind in ("csv", "json", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        spark.createDataFrame([(1, "a")], "x long, y string").write.format(kind).option("header", True).save(path)
        for _ in range(2):
            assert e.from_(path, order_by="x").collect()[0]["y"] == "a"
        spark.createDataFrame([(7, 8)], "x long, z long").write.format(kind).mode("overwrite").option("header", True).save(path)
        assert e.from_(path, order_by="x").collect()[0]["z"] == 8
    with pytest.raises(TypeError):
        e.from_(5)


def test_streams_refuse_order(e, spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "s"))
    stream = e.from_(spark.readStream.schema("id long").parquet(str(tmp_path / "s")))
    assert stream.where("id > 1").df.isStreaming
    with pytest.raises(ValueError):
        stream.window("row_number")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5)), min_size=1, max_size=12))
def test_model(e, rows):
    data = [{"k": k, "v": v} for k, v in rows]
    p = e.from_(data)
    assert col(p.window("running_sum", "v", "k", as_="w"), "w") == [sum(y["v"] for y in data[: i + 1] if y["k"] == x["k"]) for i, x in enumerate(data)]
    first = {}
    for x in data:
        first.setdefault(x["k"], x["v"])
    assert [(r["k"], r["v"]) for r in p.distinct("k").collect()] == list(first.items())
    assert col(p.order_by("v", "desc"), "v") == [x["v"] for x in sorted(data, key=lambda x: -x["v"])]
