"""The registered queries, and the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.plans.engine import Engine
from relspan.plans.pipeline import Pipeline

KEYS = {"orders": "o_orderkey", "events": "event_id", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "documents": "doc_id"}
REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def table(spark: SparkSession, d: str, name: str) -> Pipeline:
    return Engine(spark).from_(f"{d}/{name}.parquet", order_by=KEYS.get(name))


def query(name: str, sql: str | None):
    """Register a function of a reader of tables that gives a DataFrame."""

    def add(function: Callable) -> Callable:
        REGISTRY[name] = (lambda spark, d: function(lambda t: table(spark, d, t)), sql)
        return function

    return add


def simple(name: str, sql: str, build: Callable) -> None:
    query(name, sql)(build)


# Filters and projections.
for _name, _expr, _where in [
    ("where_expr", "item['o_orderstatus'] == 'F' and o_totalprice > 100000", "o_orderstatus = 'F' AND o_totalprice > 100000"),
    ("where_in", "o_orderpriority in ['1-URGENT', '2-HIGH']", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("where_or_precedence", "o_orderstatus == 'F' or o_orderstatus == 'O' and o_totalprice > 150000", "(o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 150000"),
    ("where_not", "!(o_totalprice < 200000) and not contains(o_orderpriority, 'LOW')", "NOT o_totalprice < 200000 AND NOT contains(o_orderpriority, 'LOW')"),
    ("where_ternary", "o_orderstatus == 'F' ? o_totalprice > 100000 : o_totalprice > 200000", "CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 100000 ELSE o_totalprice > 200000 END"),
    ("where_arithmetic", "o_orderkey % 7 == 3 and o_totalprice / 2 + 10 > 50000 - 1", "o_orderkey % 7 = 3 AND o_totalprice / 2 + 10 > 50000 - 1"),
]:
    simple(_name, f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_where}", lambda t, e=_expr: t("orders").where(e).select({"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}).df)

simple("where_functions", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND strlen(p_name) > 10 AND NOT starts_with(p_type, 'SMALL')", lambda t: t("part").where("contains(lower(p_name), 'a') and length(p_name) > 10 and !starts(p_type, 'SMALL')").select({"p_partkey": "p_partkey", "p_name": "p_name"}).df)
simple(
    "select_expr",
    "SELECT o_orderkey, o_totalprice * 2 + 1 AS twice, o_orderstatus || '-' || o_orderpriority AS tag, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, o_orderkey % 10 AS digit FROM orders",
    lambda t: t("orders").select({"o_orderkey": "o_orderkey", "twice": "o_totalprice * 2 + 1", "tag": "o_orderstatus ~ '-' ~ o_orderpriority", "size": "o_totalprice > 100000 ? 'big' : 'small'", "digit": "o_orderkey % 10"}).df,
)
simple(
    "select_text_functions",
    """SELECT p_partkey, upper(p_name) AS u, strlen(p_name) AS n, substr(p_name, 1, 3) AS head, right(p_name, 3) AS tail, replace(p_name, ' ', '_') AS r,
    string_split(p_name, ' ')[1] AS first_word, trim('  ' || p_brand || '  ') AS b, ends_with(p_type, 'STEEL') AS steel FROM part""",
    lambda t: t("part").select({"p_partkey": "p_partkey", "u": "upper(p_name)", "n": "length(p_name)", "head": "substr(p_name, 0, 3)", "tail": "substr(p_name, -3)", "r": "replace(p_name, ' ', '_')", "first_word": "split(p_name, ' ')[0]", "b": "trim('  ' ~ p_brand ~ '\\t ')", "steel": "ends(p_type, 'STEEL')"}).df,
)
simple(
    "select_number_functions",
    """SELECT p_partkey, abs(0 - p_retailprice) AS a, round(p_retailprice / 7, 2) AS r, ceil(p_retailprice / 3)::DOUBLE AS c, floor(p_retailprice / 3)::DOUBLE AS f, least(p_size, 20)::BIGINT AS lo, greatest(p_size, 20)::BIGINT AS hi,
    least(greatest(p_retailprice, 950.0), 1200.0) AS k, p_size::VARCHAR || 'x' AS s, trunc(p_retailprice)::BIGINT AS i, power(p_size, 2) AS sq FROM part""",
    lambda t: t("part").select({"p_partkey": "p_partkey", "a": "abs(0 - p_retailprice)", "r": "round(p_retailprice / 7)", "c": "ceil(p_retailprice / 3)", "f": "floor(p_retailprice / 3)", "lo": "int(min(p_size, 20))", "hi": "int(max(p_size, 20))", "k": "clamp(p_retailprice, 950.0, 1200.0)", "s": "str(p_size) ~ 'x'", "i": "int(p_retailprice)", "sq": "p_size ** 2"}).df,
)
simple(
    "select_more_functions",
    """SELECT p_partkey, ltrim('  ' || p_brand || ' ') AS l, rtrim('  ' || p_brand || ' ') AS r, array_to_string(string_split(p_name, ' '), '+') AS j, (p_size::VARCHAR || '.5')::DOUBLE AS f, p_size > 0 AS b,
    len(string_split(p_name, ' ')) AS n, len([p_size, 1, 2]) AS three, epoch(now()) > 1700000000 AS late, p_name IS NOT NULL AS there, p_name = '' AS none, -p_retailprice AS neg, -(p_size - 1)::BIGINT AS less FROM part""",
    lambda t: t("part").select({"p_partkey": "p_partkey", "l": "ltrim('  ' ~ p_brand ~ ' ')", "r": "rtrim('  ' ~ p_brand ~ ' ')", "j": "join(split(p_name, ' '), '+')", "f": "float(p_size ~ '.5')", "b": "bool(p_size)", "n": "count(split(p_name, ' '))", "three": "count([p_size, 1, 2])", "late": "now() > 1700000000", "there": "isset(p_name)", "none": "empty(p_name)", "neg": "-p_retailprice", "less": "-(p_size - 1)"}).df.withColumns({"n": F.col("n").cast("long"), "three": F.col("three").cast("long")}),
)
simple("where_unequal", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice <= 150000", lambda t: t("orders").where("o_orderstatus != 'F' and o_totalprice <= 150000").df.select("o_orderkey"))
simple("select_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders", lambda t: t("orders").select({"o_orderkey": "o_orderkey", "month": "date('Y-m', o_orderdate)"}).df)
simple("pluck", "SELECT c_name AS value FROM customer", lambda t: t("customer").pluck("c_name").df)
simple("partition_counts", "SELECT count(*) FILTER (o_totalprice > 100000) AS pass_count, count(*) FILTER (NOT o_totalprice > 100000) AS fail_count, count(*) AS total_count, avg((o_totalprice > 100000)::INT) AS pass_rate FROM orders WHERE o_orderstatus = 'F'", lambda t: t("orders").where("o_orderstatus == 'F'").partition("o_totalprice > 100000").counts())
simple("partition_pass", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000", lambda t: t("orders").partition("o_totalprice > 100000").passed.select({"o_orderkey": "o_orderkey"}).df)
simple("partition_fail", "SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 100000", lambda t: t("orders").partition("o_totalprice > 100000").failed.select({"o_orderkey": "o_orderkey"}).df)

# Joins.
_building = "c_mktsegment == 'BUILDING'"
simple("inner_join", "SELECT o_orderkey, c_name AS owner FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0", lambda t: t("orders").inner_join(t("customer"), "o_custkey", "c_custkey", "owner").where("owner.c_acctbal > 0").select({"o_orderkey": "o_orderkey", "owner": "owner['c_name']"}).df)
simple("left_join", "SELECT o_orderkey, c_name AS owner FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey", lambda t: t("orders").left_join(t("customer").where(_building), "o_custkey=c_custkey", "owner").select({"o_orderkey": "o_orderkey", "owner": "owner.c_name"}).df)
simple("semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", lambda t: t("orders").semi_join(t("customer").where(_building), "o_custkey", "c_custkey").pluck("o_orderkey").df.withColumnRenamed("value", "o_orderkey"))
simple("anti_join", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", lambda t: t("orders").anti_join(t("customer").where(_building), "o_custkey", "c_custkey").pluck("o_orderkey").df.withColumnRenamed("value", "o_orderkey"))
simple("cross_join", "SELECT r_name AS a_r_name, n_name AS b_n_name FROM region CROSS JOIN nation", lambda t: t("region").cross_join(t("nation"), "a_", "b_").df.select("a_r_name", "b_n_name"))
simple("zip", "SELECT r_name, n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS j FROM nation) ON i = j", lambda t: t("region").zip(t("nation")).df.select("r_name", "n_name"))

# Sets.
_high, _late = "o_totalprice > 100000", "o_orderkey % 3 == 0"
simple("intersect_by", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)", lambda t: t("customer").intersect(t("customer").where("c_acctbal > 9000"), by="c_nationkey").df.select("c_custkey"))
simple("except_by", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 3 <> 0", lambda t: t("orders").where(_high).except_(t("orders").where(_late), by="o_orderkey").df.select("o_orderkey"))
simple("union_by", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY side, o_orderkey) AS n FROM (SELECT *, 0 AS side FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT *, 1 FROM orders WHERE o_orderkey % 3 = 0)) WHERE n = 1", lambda t: t("orders").where(_high).union(t("orders").where(_late), by="o_custkey").df.select("o_orderkey", "o_custkey"))
simple("union_rows", "SELECT c_nationkey AS value FROM customer UNION SELECT s_nationkey FROM supplier", lambda t: t("customer").pluck("c_nationkey").union(t("supplier").pluck("s_nationkey")).df)
simple("symmetric_diff", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000) <> (o_orderkey % 3 = 0)", lambda t: t("orders").where(_high).symmetric_diff(t("orders").where(_late), by="o_orderkey").df.select("o_orderkey"))

# Groups.
simple("group_basic", "SELECT o_orderstatus AS _group, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1", lambda t: t("orders").group_by("o_orderstatus").aggregate({"n": "count(*)", "total": "sum(o_totalprice)", "mean": "avg(o_totalprice)", "lo": "min(o_totalprice)", "hi": "max(o_totalprice)"}).df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)}))
simple("group_expr_key", "SELECT strftime(o_orderdate, '%Y') || '/' || o_orderstatus AS _group, count(*) AS n FROM orders GROUP BY 1", lambda t: t("orders").group_by("date('Y', o_orderdate) ~ '/' ~ o_orderstatus").aggregate({"n": "count(*)"}).df)
simple("group_int_key", "SELECT l_linenumber::VARCHAR AS _group, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1", lambda t: t("lineitem").group_by("l_linenumber").aggregate({"revenue": "sum(l_extendedprice * (1 - l_discount))"}).df.withColumn("revenue", F.round("revenue", 2)))
simple("group_rows", "SELECT n_regionkey::VARCHAR AS _group, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1", lambda t: t("nation").group_by("n_regionkey").rows().df.select("_group", F.array_join("rows.n_name", ",").alias("names")))
simple("agg_flat", "SELECT '*' AS _group, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_returnflag = 'R'", lambda t: t("lineitem").where("l_returnflag == 'R'").aggregate({"n": "count(*)", "q": "sum(l_quantity)"}).df.withColumn("q", F.round("q", 2)))
simple("agg_flat_empty", "SELECT '*' AS _group, 0::BIGINT AS n, 0.0::DOUBLE AS q, NULL::DOUBLE AS m FROM range(1)", lambda t: t("orders").where("o_orderkey < 0").aggregate({"n": "count(*)", "q": "sum(o_totalprice)", "m": "avg(o_totalprice)"}).df)
simple(
    "agg_stats",
    "SELECT o_orderpriority AS _group, median(o_totalprice) AS med, round(stddev_samp(o_totalprice), 4) AS sd, round(var_samp(o_totalprice) / 1e6, 4) AS va, list_sort(list(o_totalprice))[greatest(ceil(0.9::DOUBLE * count(o_totalprice)), 1)::BIGINT] AS p90 FROM orders GROUP BY 1",
    lambda t: t("orders").group_by("o_orderpriority").aggregate({"med": "median(o_totalprice)", "sd": "stddev(o_totalprice)", "va": "variance(o_totalprice)", "p90": "percentile(o_totalprice, 0.9)"}).df.withColumns({"sd": F.round("sd", 4), "va": F.round(F.col("va") / 1e6, 4)}),
)
simple("agg_distinct", "SELECT o_orderstatus AS _group, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1", lambda t: t("orders").group_by("o_orderstatus").aggregate({"customers": "count_distinct(o_custkey)"}).df)
simple("agg_bool", "SELECT o_orderpriority AS _group, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some FROM orders GROUP BY 1", lambda t: t("orders").group_by("o_orderpriority").aggregate({"every": "bool_and(o_totalprice > 1000)", "some": "bool_or(o_totalprice > 400000)"}).df)
simple("agg_string", "SELECT n_regionkey::VARCHAR AS _group, string_agg(n_name, ' | ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1", lambda t: t("nation").group_by("n_regionkey").aggregate({"names": 'string_agg(n_name, " | ")'}).df)
simple("agg_first_last", "SELECT o_custkey::VARCHAR AS _group, arg_min(o_totalprice, o_orderkey) AS head, arg_max(o_totalprice, o_orderkey) AS tail FROM orders GROUP BY 1", lambda t: t("orders").group_by("o_custkey").aggregate({"head": "first(o_totalprice)", "tail": "last(o_totalprice)"}).df)
simple("agg_mode", "SELECT g AS _group, arg_max(v, c * 1000000000 - p) AS top FROM (SELECT user_id::VARCHAR AS g, event_type AS v, count(*) AS c, min(event_id) AS p FROM events GROUP BY 1, 2) GROUP BY 1", lambda t: t("events").group_by("user_id").aggregate({"top": "mode(event_type)"}).df)
simple(
    "agg_ntile",
    "SELECT o_orderstatus AS _group, s[greatest(1, round(0.25 * n)::BIGINT)] AS a, s[greatest(1, round(0.5 * n)::BIGINT)] AS b, s[greatest(1, round(0.75 * n)::BIGINT)] AS c FROM (SELECT o_orderstatus, list_sort(list(o_totalprice)) AS s, count(*) AS n FROM orders GROUP BY 1)",
    lambda t: t("orders").group_by("o_orderstatus").aggregate({"q": "ntile(o_totalprice)"}).df.select("_group", *[F.col("q")[i].alias(c) for i, c in enumerate("abc")]),
)
simple("agg_cume_dist", "SELECT '*' AS _group, l_linenumber AS k, round(sum(count(*)) OVER (ORDER BY l_linenumber) / sum(count(*)) OVER (), 6) AS v FROM lineitem GROUP BY l_linenumber", lambda t: t("lineitem").aggregate({"d": "cume_dist(l_linenumber)"}).df.select("_group", F.explode("d").alias("k", "v")))
simple("tally", "SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1", lambda t: t("events").tally("event_type").df)

# Windows.
for _part, _suffix in ((None, ""), ("o_custkey", "_part")):
    _p = "PARTITION BY o_custkey " if _part else ""
    for _fn, _sql, _digits in [
        ("running_sum", "round(sum(o_totalprice) OVER ({p}ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2)", 2),
        ("running_avg", "round(avg(o_totalprice) OVER ({p}ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) + 0.0013, 2)", 2),
        ("running_count", "count(*) OVER ({p}ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)", None),
        ("running_diff", "round(o_totalprice - lag(o_totalprice) OVER ({p}ORDER BY o_orderkey), 2)", 2),
        ("rank", "rank() OVER ({p}ORDER BY o_totalprice DESC)", None),
        ("dense_rank", "dense_rank() OVER ({p}ORDER BY o_totalprice DESC)", None),
        ("row_number", "row_number() OVER ({p}ORDER BY o_orderkey)", None),
        ("lag", "lag(o_totalprice, 2) OVER ({p}ORDER BY o_orderkey)", None),
        ("lead", "lead(o_totalprice, 2) OVER ({p}ORDER BY o_orderkey)", None),
        ("ntile", "least(floor((row_number() OVER ({p}ORDER BY o_orderkey) - 1)::DOUBLE / count(*) OVER ({q}) * 4) + 1, 4)::BIGINT", None),
        ("cume_dist", "round(cume_dist() OVER ({p}ORDER BY o_totalprice), 6)", None),
    ]:

        def _build(t, fn=_fn, part=_part, digits=_digits):
            df = t("orders").window(fn, "o_totalprice", part, as_="w", offset=2).df.select("o_orderkey", "w")
            shift = 0.0013 if fn == "running_avg" else 0  # off the middle between two decimals
            return df.withColumn("w", F.round(F.col("w") + shift, digits)) if digits else df

        simple(f"win_{_fn}{_suffix}", f"SELECT o_orderkey, {_sql.format(p=_p, q=_p.strip())} AS w FROM orders", _build)
simple("moving_average", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) >= 7 THEN round(avg(value) OVER (ORDER BY event_id ROWS 6 PRECEDING), 4) END AS m FROM events", lambda t: t("events").moving_average("value", 7, "m").df.select("event_id", F.round("m", 4).alias("m")))
simple("normalize", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS x FROM part", lambda t: t("part").normalize("p_retailprice", "x").df.select("p_partkey", "x"))
simple("rank_by", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders", lambda t: t("orders").rank_by("o_totalprice").df.select("o_orderkey", "rank"))

# Order and slices.
simple("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20", lambda t: t("orders").order_by([["o_orderpriority", "asc"], ["o_totalprice", "DESC"]]).limit(50, 20).df.select("o_orderkey", "o_totalprice"))
simple("limit_from_end", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10) ORDER BY o_orderkey LIMIT 4", lambda t: t("orders").limit(4, -10).df.select("o_orderkey"))
simple("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", lambda t: t("orders").top_n(25, "o_totalprice").df.select("o_orderkey", "o_totalprice"))
simple("bottom_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25", lambda t: t("orders").bottom_n(25, "o_totalprice").df.select("o_orderkey", "o_totalprice"))

# Shapes.
simple("distinct_on", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", lambda t: t("orders").distinct("o_custkey").df.select("o_custkey", "o_orderkey"))
simple("reindex_last", "SELECT o_custkey::VARCHAR AS _key, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1", lambda t: t("orders").reindex("o_custkey").df.select("_key", "o_orderkey"))
simple("chunk", "SELECT (i - 1) // 100 AS chunk_id, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS keys FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) GROUP BY 1", lambda t: t("customer").chunk(100).df.select("chunk_id", F.size("rows").cast("long").alias("n"), F.array_join("rows.c_custkey", ",").alias("keys")))
simple("fill_gaps", "SELECT k::BIGINT AS n, coalesce(v, -1) AS v FROM range(0, 40) s(k) LEFT JOIN (SELECT n_nationkey AS n, n_regionkey::BIGINT AS v FROM nation) ON k = n", lambda t: t("nation").select({"n": "int(n_nationkey)", "v": "int(n_regionkey)"}).fill_gaps("n", list(range(40)), {"v": -1}).df)
simple("transpose", "SELECT 'r_regionkey' AS key, string_agg(r_regionkey::VARCHAR, ',' ORDER BY r_regionkey) AS vals FROM region UNION ALL SELECT 'r_name', string_agg(r_name, ',' ORDER BY r_regionkey) FROM region", lambda t: t("region").transpose().df.select("key", F.array_join("value", ",").alias("vals")))
_statuses = ["F", "O", "P"]
simple("pivot_sum", "SELECT o_orderpriority AS _row, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2) AS \"{s}\"" for s in _statuses) + " FROM orders GROUP BY 1", lambda t: t("orders").pivot("o_orderpriority", "o_orderstatus", "o_totalprice", values=_statuses).df.select("_row", *[F.round(s, 2).alias(s) for s in _statuses]))
simple("pivot_avg", "SELECT o_orderpriority AS _row, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 4) AS \"{s}\"" for s in _statuses) + " FROM orders GROUP BY 1", lambda t: t("orders").pivot("o_orderpriority", "o_orderstatus", "o_totalprice", "avg").df.select("_row", *[F.round(s, 4).alias(s) for s in _statuses]))
simple("sample", None, lambda t: t("orders").sample(100, seed=42).df)
simple("sample_counts", "SELECT 100::BIGINT AS n, 100::BIGINT AS keys, 100::BIGINT AS known", lambda t: t("orders").sample(100, seed=42).semi_join(t("orders"), "o_orderkey", "o_orderkey").df.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.count_if(F.col("o_totalprice") > 0).alias("known")))

# Whole pipelines.
simple(
    "dashboard",
    "SELECT c_mktsegment AS _group, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1",
    lambda t: t("orders").where("o_orderstatus == 'F'").inner_join(t("customer"), "o_custkey", "c_custkey", "owner").group_by("owner.c_mktsegment").aggregate({"revenue": "sum(o_totalprice)", "orders": "count(*)"}).order_by("revenue", "desc").limit(10).df.withColumn("revenue", F.round("revenue", 2)),
)
simple(
    "monthly_trend",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)
    SELECT month, round(revenue, 2) AS revenue, round(sum(revenue) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS total, round(lag(revenue) OVER (ORDER BY month), 2) AS before,
    CASE WHEN row_number() OVER (ORDER BY month) >= 3 THEN round(avg(revenue) OVER (ORDER BY month ROWS 2 PRECEDING), 2) END AS smooth FROM m""",
    lambda t: t("orders").group_by("date('Y-m', o_orderdate)").aggregate({"revenue": "sum(o_totalprice)"}).order_by("_group").window("running_sum", "revenue", as_="total").window("lag", "revenue", as_="before").moving_average("revenue", 3, "smooth").df.select(F.col("_group").alias("month"), *[F.round(c, 2).alias(c) for c in ("revenue", "total", "before", "smooth")]),
)
simple(
    "seven_op",
    """SELECT n_name AS _group, round(sum(o_totalprice), 2) AS revenue, count(*) AS n, round(max(cumulative), 2) AS most FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS cumulative FROM orders WHERE o_orderstatus = 'F')
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC LIMIT 10""",
    lambda t: t("orders").where("item['o_orderstatus'] == 'F'").inner_join(t("customer"), "o_custkey", "c_custkey", "owner").inner_join(t("nation"), "owner.c_nationkey", "n_nationkey", "nation").window("running_sum", "o_totalprice", "o_custkey", as_="cumulative").group_by("nation.n_name").aggregate({"revenue": "sum(o_totalprice)", "n": "count(*)", "most": "max(cumulative)"}).order_by("revenue", "desc").limit(10).df.withColumns({c: F.round(c, 2) for c in ("revenue", "most")}),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, (build, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
