"""Groups, aggregates of groups or of all rows, counts by value, and pivots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.functions.aggregates import BUILT_IN, COUNTED, ORDERED, AggregateRegistry, Input, read_spec, spec_value
from relspan.functions.semantics import text
from relspan.plans.frame import Frame, hidden


@dataclass(frozen=True)
class Grouped:
    """A frame whose rows have a group, in a hidden column."""

    frame: Frame
    key: str

    def collected(self) -> Frame:
        """(_group, rows): each group's rows as an array, in order; groups in the order of their first rows."""
        f, place = self.frame.place()
        spot = hidden()
        rows = F.sort_array(F.collect_list(F.struct(place.alias("p"), F.struct(*[F.col(f"`{c}`") for c in f.columns]).alias("r"))))
        df = f.df.groupBy(F.col(self.key).alias("_group")).agg(F.transform(rows, lambda x: x["r"]).alias("rows"), F.min(place).alias(spot))
        return f.with_(df, order=((spot, True),))


def group_by(frame: Frame, key) -> Grouped:
    name = hidden()
    f = frame.with_(frame.df.withColumn(name, text(frame.value(key))), f"group_by({key if isinstance(key, str) else 'function'})")
    return Grouped(f, name)


def aggregate(frame: Frame, key: str | None, specs: dict[str, str], registry: AggregateRegistry) -> Frame:
    """One row a group, or one row "*" of all, also of none; all specs share one pass, but for mode, ntile and cume_dist."""
    parsed = {alias: read_spec(spec) for alias, spec in specs.items()}
    builders = {alias: COUNTED[name] if name in COUNTED and registry.get(name) is BUILT_IN[name] and frame.large() else registry.get(name) for alias, (name, _, _) in parsed.items()}
    flat = key is None
    if flat:
        key = hidden()
        frame = frame.with_(frame.df.withColumn(key, F.lit("*")))
    spot = hidden()
    firsts = [(F.min(spot), True)]
    if any(name in ORDERED for name, _, _ in parsed.values()):
        frame, place = frame.place()
        df = frame.df.withColumn(spot, place)
    elif frame.order and not flat:
        frame, spot, firsts = frame.firsts()
        df = frame.df
    else:
        df = frame.df.withColumn(spot, F.lit(0))
    inputs, columns = {}, {}
    for alias, (_, expr, args) in parsed.items():
        x = spec_value(frame, expr)
        name = hidden()
        columns[name] = x.col
        inputs[alias] = Input(name, x.type, spot, args)
    df = df.select(key, spot, *[c.alias(n) for n, c in columns.items()])
    plain = [builders[a](inputs[a]).alias(a) for a in specs if not getattr(builders[a], "side", False)]
    firsts = [(hidden(), x, up) for x, up in firsts]
    plain += [x.alias(n) for n, x, _ in firsts]
    out = df.agg(*plain).withColumn(key, F.lit("*")) if flat else df.groupBy(key).agg(*plain)
    for alias in specs:
        if getattr(builders[alias], "side", False):
            k = hidden()
            side = builders[alias](df, key, inputs[alias]).select(F.col(key).alias(k), F.col("value").alias(alias))
            out = out.join(side, F.col(key) == F.col(k), "left").drop(k)
    out = out.select(F.col(key).alias("_group"), *[F.col(f"`{a}`") for a in specs], *[n for n, _, _ in firsts])
    return frame.with_(out, f"aggregate({', '.join(f'{a}={s}' for a, s in specs.items())})", tuple((n, up) for n, _, up in firsts))


def tally(frame: Frame, field: str) -> Frame:
    """(key, value): how often each text value occurs, most frequent first, of equal ones the first met."""
    f, place = frame.place() if frame.order else (frame, None)
    n, spot = hidden(), hidden()
    first = F.min(place) if place is not None else F.min("key")
    rows = f.df.select(text(f.value(field)).alias("key"), *([place.alias(spot)] if place is not None else []))
    df = rows.groupBy("key").agg(F.count("*").alias("value"), (F.min(spot) if place is not None else first).alias(spot)).withColumn(n, F.col("value"))
    return f.with_(df, f"tally({field})", ((n, False), (spot, True)))


def pivot(frame: Frame, rows: str, cols: str, value: str, function: str, registry: AggregateRegistry, values: list | None = None) -> Frame:
    """A row for each value of `rows` (as _row), a column for each of `cols` in the order met, aggregates of `value` in the cells.

    Without `values` the columns are found by a query of their own, as many as spark.sql.pivotMaxValues allows.
    """
    f, place = frame.place()
    spot, c, r, v = hidden(), hidden(), hidden(), hidden()
    x = f.value(value)
    df = f.df.select(text(f.value(rows)).alias("_row"), text(f.value(cols)).alias(c), x.col.alias(v), place.alias(spot))
    if values is None:
        most = int(f.df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        met = df.groupBy(c).agg(F.min(spot).alias("p")).orderBy("p").limit(most + 1).select(c).collect()
        if len(met) > most:
            raise ValueError(f"more than {most} columns; see spark.sql.pivotMaxValues")
        values = [r[0] for r in met]
    builder = registry.get(function)
    if getattr(builder, "side", False):
        cell = hidden()
        both = df.withColumn(cell, F.to_json(F.struct("_row", F.col(c).alias("c"))))
        side = builder(both, cell, Input(v, x.type, spot))
        side = side.select(F.from_json(cell, "_row string, c string").alias("k"), "value").select("k.*", "value")
        cells = side.groupBy("_row").pivot("c", values).agg(F.first("value"))
    else:
        cells = df.groupBy("_row").pivot(c, values).agg(builder(Input(v, x.type, spot)))
        present: DataFrame | None = None
        if function in ("count", "sum", "bool_and", "bool_or", "count_distinct"):
            # These have a value for no rows; a cell without rows is null.
            present = df.groupBy("_row").pivot(c, values).agg(F.count(F.lit(1)))
            ns = [hidden() for _ in values]
            marks = present.select(F.col("_row").alias(r), *[F.col(f"`{x}`").alias(n) for x, n in zip(values, ns, strict=True)])
            cells = cells.join(marks, F.col("_row") == F.col(r)).select("_row", *[F.when(F.col(n) > 0, F.col(f"`{x}`")).alias(x) for x, n in zip(values, ns, strict=True)])
    at = df.groupBy(F.col("_row").alias(r)).agg(F.min(spot).alias(spot))
    out = cells.join(at, F.col("_row") == F.col(r)).drop(r)
    return f.with_(out, f"pivot({rows} x {cols}, {function}({value}))", ((spot, True),))

