"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, and an index holds every distinct code under each of its segments. A query first
looks up its own segments, then those that differ in one bit, and so on; where a radius has over FINE masks, one segment
after another. After radius r in the first a segments, and r - 1 in the others, all codes within a Hamming distance of
segments * r + a - 1 have been met, so a query is finished as soon as its kth best verified distance is no larger than
that; only the others go on. What is met beyond a query's kth best distance so far is dropped where it is met.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspan.llm._store import materialize, small

BITS = 64
#: Masks of a radius from which the segments are searched one at a time.
FINE = 100
#: Entries of an index up to which these are broadcast (a code and its k + 1 least ids each: 65 MB for k = 10).
BROADCAST = 500_000


def sign_code(vector: Column) -> Column:
    """The 64-bit code of a vector of up to 64 components: bit i is set if component i is above zero (null: not)."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segment_count(codes: int) -> int:
    """Segments of about log2(codes) bits, so that a list holds a few codes: a divisor of 64, from 4 to 16.

    Two segments of 32 bits would need up to 601,080,390 masks of one radius; four need 12,870 at most.
    """
    want = BITS / max(4.0, log2(max(2, codes)))
    return min((4, 8, 16), key=lambda m: (abs(m - want), m))


def _smallest(base: DataFrame, n: int) -> DataFrame:
    """(code, ids): the n smallest ids of each code, first by parts of a code's rows, so that a common code is not gathered at once."""
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    for keys in (["code", "part"], ["code"]):
        base = base.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("at") <= n).select("code", "id")
    return base.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _top(met: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each query; Spark cuts each task's rows of a query to k ahead of the shuffle."""
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    near = met.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "distance", "id", "rank")


def _steps(segments: int, width: int) -> list[tuple[int, list[int]]]:
    """The radius of each step and the segments that are searched in it."""
    every = list(range(segments))
    return [(r, some) for r in range(width + 1) for some in ([[a] for a in every] if comb(width, r) > FINE else [every])]


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k rows of least Hamming distance of each query, itself left out.

    Equal distances are ranked by id. Rows with a null id or code are in no result and queries with one have none;
    repeated rows count once, an id with several codes is as near as its nearest one, and rows that share an id with
    the query are not its neighbours. A query with fewer than k other ids has them all. Other columns are ignored, and
    an empty table gives no rows.

    Equal codes are collapsed to their k + 1 smallest ids, which is all that a result can hold of them.
    """
    wanted = queries.select(F.col(id_col).alias("query_id"), F.col(code_col).alias("q")).where("query_id is not null and q is not null").distinct()
    base = rows.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).where("id is not null and code is not null").distinct()
    kept = materialize(_smallest(base, k + 1), "codes")
    codes = kept.count()
    m = segment_count(codes)
    width = BITS // m
    mask = (1 << width) - 1
    segment = lambda code, i: F.shiftrightunsigned(code, i * width).bitwiseAND(F.lit(mask))
    cuts = lambda code, some: F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), segment(code, i).alias("val")) for i in some]))
    index = materialize(kept.select("code", "ids", cuts("code", range(m)).alias("at")).select("at.seg", "at.val", "code", "ids"), "index")

    # far is what a neighbour has to be within to count, more the number of ids that a query may meet at all.
    others = base.select("id").distinct()
    total = others.count()
    several = base.count() > total  # ids of more than one code: one that was met may have a nearer code
    own = others.select(F.col("id").alias("query_id"), F.lit(1).alias("own"))
    active = wanted.join(own, "query_id", "left").select("query_id", "q", F.lit(BITS).alias("far"), (F.lit(total) - F.coalesce("own", F.lit(0))).alias("more"))
    active = materialize(active.where("more > 0"), "queries")
    best, done = None, []
    for r, some in _steps(m, width):
        if active.isEmpty():
            break
        masks_at = [sum(1 << b for b in bits) for bits in combinations(range(width), r)]
        probes = active.select("query_id", "q", "far", cuts("q", some).alias("at")).select("query_id", "q", "far", "at.seg", F.col("at.val").alias("own"))
        if len(masks_at) <= 256:
            probes = probes.withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in masks_at])))
        else:
            masks = rows.sparkSession.createDataFrame([(x,) for x in masks_at], "flip long")
            probes = probes.join(F.broadcast(masks))  # fixed by the width: all masks of r bits
        probes = probes.select("query_id", "q", "far", "seg", F.col("own").bitwiseXOR(F.col("flip")).alias("val"))
        met = probes.join(small(index.where(F.col("seg").isin(some)), codes * len(some), BROADCAST), ["seg", "val"]).withColumn("distance", F.bit_count(F.col("code").bitwiseXOR(F.col("q"))).cast("int")).where("distance <= far")
        met = met.select("query_id", "distance", F.explode("ids").alias("id")).where("id <> query_id")
        if best is not None:
            met = met.unionByName(best.select("query_id", "distance", "id"))
        best = materialize(_top(met, k), "best")
        covered = m * r + some[-1]
        reached = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        state = active.join(reached, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        all_met = F.lit(False) if several else F.col("n") >= F.col("more")
        end = F.lit(r == width and some[-1] == m - 1) | all_met | (F.col("n") >= F.least(F.lit(k), "more")) & (F.col("kth") <= covered)
        state = state.select("query_id", "q", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(BITS)).alias("far"), "more", end.alias("finished"))
        state = materialize(state, "state")
        done.append(best.join(state.where("finished").select("query_id"), "query_id", "left_semi"))
        active = state.where("not finished").drop("finished")
        best = best.join(active.select("query_id"), "query_id", "left_semi")
    if not done:
        done = [base.limit(0).join(wanted.limit(0)).select("query_id", F.lit(0).alias("distance"), "id", F.lit(0).cast("long").alias("rank"))]
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("query_id", "rank", F.col("id").alias("neighbor_id"), F.col("distance").cast("long").alias("distance"))
