"""Near-duplicate vectors by a pivot-permutation index, verified by cosine in double precision.

Pivots are a bounded sample of the vectors, spread: none is close to another, so a crowded group has one or few of them
and its members meet in the same lists. A vector is described by its NEAREST nearest pivots in order; an inverted list
per pivot holds the vectors that have it among these. Two vectors are candidates if they share SHARED = 2 of these
pivots. They meet in the list of the smallest pivot that they share, in its part of those that have the second smallest
one too; pairs that share a smaller pivot besides belong elsewhere, so each is verified once. The parts of a long list
are lists of their own; what is longer than a block even so is cut into blocks, each pair of which is a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._graph import components
from relspan.llm._store import materialize, small

#: Pivots: about the root of the number of vectors, within these bounds (the most is 4096 vectors).
PIVOTS_LEAST, PIVOTS_MOST = 64, 4096
#: Lists that a vector stands in, and how many of these two candidates share.
NEAREST, SHARED = 6, 2
#: Cosine from which a pivot is too close to another.
SPREAD = 0.8
#: Vectors from which a list is dealt out by the second pivot.
LONG = 8000
#: Vectors in a block of a list; in lists of over MANY blocks these grow, up to BLOCK_MOST vectors.
BLOCK, MANY, BLOCK_MOST = 4000, 8, 16_000
#: Pairs of vectors that are compared at a time.
PAIRS = 1 << 20


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one: not null, of the most common length, finite, not zero."""
    n = len(column)
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0))
    out, ok = np.zeros((n, width)), np.zeros(n, dtype=bool)
    rows = np.flatnonzero(size == width) if width else np.zeros(0, dtype=np.int64)
    if not len(rows):
        return out, ok
    v = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # null: NaN
    top = np.abs(v).max(axis=1)
    good = np.isfinite(v).all(axis=1) & (top > 0)
    v = v[good] / top[good, None]  # keeps the squares in range
    out[rows[good]], ok[rows[good]] = v / np.sqrt((v * v).sum(axis=1))[:, None], True
    return out, ok


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """The first `count` unit vectors of the sample that are not close to one taken before."""
    taken: list[int] = []
    for at in range(0, len(sample), 512):
        part = sample[at : at + 512]
        free = (part @ sample[taken].T < SPREAD).all(axis=1)
        far = part @ part.T < SPREAD
        for i in range(len(part)):
            if free[i]:
                taken.append(at + i)
                free &= far[i]
    return sample[taken[:count]]


def _describe(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, nearest: int) -> Iterator[pa.RecordBatch]:
    """Unit vectors and their nearest pivots, smallest first. A single pivot counts as two, so that all share SHARED."""
    width = pivots.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            size = pc.list_value_length(b.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
            b = b.take(pa.array(np.flatnonzero(size == width)))
            if not b.num_rows:
                continue
            unit, ok = unit_rows(b.column(2))
            unit = unit[ok]
            near = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
            near = np.sort(near, axis=1) if len(pivots) > 1 else np.tile(np.arange(SHARED, dtype=np.int32), (len(unit), 1))
            rows = pa.array(np.flatnonzero(ok))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([x.tobytes() for x in unit], type=pa.binary()), lists], ["id", "copies", "unit", "near"])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(key: tuple, rows: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Links within one block, or between two blocks, of one list: each vector's number of linked vectors and a smaller one it reaches.

    A list has a first pivot, and a second one or -1: then each further pivot of its vectors has a part of the list.
    """
    pivot, second, a, b = key
    rows = rows.sort_values("id", kind="stable")
    ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
    unit = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(len(rows), -1)
    near = np.stack(rows["near"].to_numpy())
    side = rows["block"].to_numpy() == b
    links, root = np.zeros(len(rows)), np.arange(len(rows))
    for q in [second] if second >= 0 else np.unique(near[near > pivot]).tolist():
        member = np.flatnonzero((near == q).any(axis=1))
        at_left, at_right = (np.ones(len(member), dtype=bool),) * 2 if a == b else (~side[member], side[member])
        left, right = member[at_left], member[at_right]
        if not len(left) or not len(right) or a == b and len(left) == 1:
            continue
        # Other shared pivots ahead of q: with one of these a pair's two smallest ones are not these two.
        before = np.unique(near[member])
        before = before[(before < q) & (before != pivot)]
        has = np.zeros((len(member), len(before)), dtype=np.float32)
        r, c = np.nonzero(np.isin(near[member], before))
        has[r, np.searchsorted(before, near[member[r], c])] = 1
        has_left, has_right = has[at_left], has[at_right]
        step = max(1, PAIRS // len(right))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            hits = has_left[at : at + step] @ has_right.T == 0
            if a == b:
                hits &= some[:, None] < right
            x = np.flatnonzero(hits.any(axis=1))
            if not len(x):
                continue
            some, hits = some[x], hits[x]
            hits &= unit[some] @ unit[right].T >= limit
            if not hits.any():
                continue
            number = hits.astype(np.float64)
            links[some] += number @ copies[right]
            links[right] += copies[some] @ number
            while True:  # an edge a row and round is enough for the components
                apart = hits & (root[some][:, None] != root[right])
                x = np.flatnonzero(apart.any(axis=1))
                if not len(x):
                    break
                y = apart[x].argmax(axis=1)
                root = _roots(len(rows), np.concatenate([np.arange(len(rows)), some[x]]), np.concatenate([root, right[y]]))
    hit = links > 0
    return pd.DataFrame({"id": ids[hit], "links": links[hit].astype(np.int64), "root": ids[root[hit]]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of vectors.

    Vectors of cosine >= limit (in double precision) that the index finds are linked, none below. n_links counts the
    other rows linked directly, component_id is the smallest id reachable, itself included, and the row of that id is
    kept. Vectors that are null, zero, of another length than the pivots, or hold null or non-finite components link
    with nothing. Equal vectors are links of each other; they are collapsed first, so a copy costs one row. Rows that
    share an id are rows of their own and of one component; a row with a null id links with nothing. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    usable = rows.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    classes = materialize(usable.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    count = min(PIVOTS_MOST, max(PIVOTS_LEAST, isqrt(n)))
    every = max(1, n // (4 * count))
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id", F.lit(1)), "id").select("v").limit(4 * count).collect() if n else []
    if not sample:
        return vectors.select(F.col(id_col).cast("long").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    lengths = [len(r.v) for r in sample]
    width = max(set(lengths), key=lambda x: (lengths.count(x), x))
    pivots, _ = unit_rows(pa.array([r.v for r in sample if len(r.v) == width], pa.list_(pa.float64())))
    shared = spark.sparkContext.broadcast(spread(pivots, count))
    near = classes.select("id", "copies", "v").mapInArrow(lambda it: _describe(it, shared.value, NEAREST), "id long, copies long, unit binary, near array<int>")
    near = materialize(near, "near")

    # Lists by pivot, long ones by pairs of pivots; the numbers of vectors are a row a pivot, or a pair that occurs.
    listed = near.select("*", F.explode("near").alias("pivot"))
    long = listed.groupBy("pivot").count().where(F.col("count") > LONG).select("pivot", F.lit(True).alias("long"))
    listed = listed.join(F.broadcast(long), "pivot", "left")  # at most PIVOTS_MOST rows
    seconds = F.when(F.col("long"), F.filter("near", lambda x: x > F.col("pivot"))).otherwise(F.array(F.lit(-1)))
    listed = listed.select("id", "copies", "unit", "near", "pivot", F.explode(seconds).alias("second"))
    sizes = materialize(listed.groupBy("pivot", "second").count(), "sizes")
    blocks = F.greatest(F.least(F.ceil(F.col("count") / BLOCK), F.lit(MANY)), F.ceil(F.col("count") / BLOCK_MOST)).cast("int")
    listed = listed.join(small(sizes.select("pivot", "second", blocks.alias("blocks"))), ["pivot", "second"])
    listed = listed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = listed.select("id", "copies", "unit", "near", "pivot", "second", "block", other)
    cells = cells.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other")
    found = cells.groupBy("pivot", "second", "a", "b").applyInPandas(lambda key, pdf: _compare(key, pdf, limit), "id long, links long, root long")
    found = materialize(found, "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    state = classes.select("v", F.col("id").alias("rep"), "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(named.withColumnRenamed("node", "rep"), "rep", "left")
    known = usable.select("id", "v").join(state, "v").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # Rows that share an id but not a vector: one component.
    twice = known.groupBy("id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi")
    if not twice.isEmpty():
        more = known.join(twice.select("id"), "id", "left_semi").select(F.col("id").alias("u"), F.col("component_id").alias("v"))
        all_named = components(known.select(F.col("id").alias("u"), F.col("component_id").alias("v")).union(more))
        known = known.drop("component_id").join(all_named.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").select("id", "n_links", F.coalesce("c", "id").alias("component_id"))
    alone = rows.where("not coalesce(id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0), false)")
    out = known.union(alone.select("id", F.lit(0).cast("long"), F.col("id")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
