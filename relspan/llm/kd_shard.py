"""Shards of nearly equal bytes by a k-d tree over document metadata, in DataFrame operations only.

A node of the tree holds documents for a number of shards. It is split along its widest dimension (of the text's
length, language and source, each over the range it has in the whole table) at the weighted quantile that
gives each side its part of the bytes. The quantile is found by narrowing: bytes are summed in 4096 equal intervals of
the dimension, then in the one that holds the quantile, until it is a single position; only sums travel, and a few
numbers a node reach the driver. All nodes of a level are split together.

Documents of the same position in the chosen dimension are told apart by the checksum of their text and then, only if
equal texts have over `whole` of a shard's bytes, by a hash of the id. So a group of equal texts is never divided if
it has no more than that, and may be if it has more; then shards could not have near equal bytes otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspan.llm._store import materialize, small

DIMENSIONS = ("size", "lang", "source")
#: A position is DIM_BITS of the dimension, 32 of the checksum and TIE_BITS of the id's hash.
DIM_BITS, CRC_BITS, TIE_BITS = 14, 32, 14
STEP_BITS = 12
#: Equal texts of up to this part of a shard's bytes are not divided.
WHOLE = 0.05


def _position(dim: Column) -> Column:
    """Place of a document in the order along a dimension (0 to 1), as a long."""
    coarse = F.least((dim * (1 << DIM_BITS)).cast("long"), F.lit((1 << DIM_BITS) - 1))
    return F.shiftleft(coarse, CRC_BITS + TIE_BITS).bitwiseOR(F.shiftleft(F.col("crc"), TIE_BITS)).bitwiseOR(F.col("tie"))


def _metadata(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string").cast("binary")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = docs.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("crc"), name(lang_col).alias("lang"), name(source_col).alias("source"))
    kept = materialize(kept, "documents")
    # Equal texts have one place in the tree: the first language and source that any of them has.
    names = F.struct("lang", "source")
    same = kept.groupBy("crc", "size").agg(F.min(names).alias("m"), F.max(names).alias("most")).where("m < most").select("crc", "size", "m")
    named = kept.join(small(materialize(same, "same")), ["crc", "size"], "left").select("id", "size", "crc", F.coalesce("m", names).alias("m"))
    placed = named.select("id", "size", "crc", *(_unit(F.col(f"m.{d}")).alias(f"d_{d}") for d in ("lang", "source")))
    # The length by its logarithm, so that a few very long texts do not flatten it; 48 bits of bytes are the range.
    return placed.withColumn("d_size", F.log2("size") / 48.0).withColumn("tie", F.pmod(F.xxhash64("id", "size"), F.lit(1 << TIE_BITS)))


def _unit(name: Column) -> Column:
    """A place from 0 to 1 for a name."""
    return F.pmod(F.xxhash64(name), F.lit(1 << 20)) / float(1 << 20)


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", whole: float = WHOLE) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of docs; law is always "bytes".

    size is the text's UTF-8 bytes (null: none) plus 8, text_crc32 the unsigned checksum of these bytes. Shards 0 to
    shards - 1 have nearly equal bytes; slots are gapless from 0 in each shard. Null languages, sources and texts count
    as empty; rows with null or repeated ids are placed like others. An empty table gives no rows. Other columns are
    ignored. Rows of equal texts share a shard unless they have over `whole` of a shard's bytes (infinity: always). grown_shard is null: no rule of this tree depends on the id and the number of shards alone.
    """
    meta = materialize(_metadata(docs, id_col, text_col, lang_col, source_col), "metadata")
    spans = meta.agg(*[f(f"d_{d}").alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))], F.sum("size").alias("bytes")).first()
    total = spans["bytes"] or 0
    target = total / shards
    nodes = meta.withColumn("first", F.lit(0)).withColumn("count", F.lit(shards))
    width = 1
    while width < shards:
        # The widest dimension of each open node, by its range here over its range in the table.
        ranges = nodes.where("count > 1").groupBy("first").agg(*[(F.max(f"d_{d}") - F.min(f"d_{d}")).alias(d) for d in DIMENSIONS], F.first("count").alias("count"), F.sum("size").alias("bytes")).collect()
        if not ranges:
            break
        chosen = {}
        for r in ranges:
            wide = {d: r[d] / (spans[f"{d}_hi"] - spans[f"{d}_lo"]) if spans[f"{d}_hi"] > spans[f"{d}_lo"] else 0.0 for d in DIMENSIONS}
            left = r["count"] // 2
            chosen[r["first"]] = (max(DIMENSIONS, key=lambda d: (wide[d], -DIMENSIONS.index(d))), left, r["bytes"] * left / r["count"])
        dim = F.lit(None).cast("double")
        for first, (d, _, _) in chosen.items():
            dim = F.when(F.col("first") == first, F.col(f"d_{d}")).otherwise(dim)
        open_ = nodes.where("count > 1").select("first", "size", _position(dim).alias("at"))
        cut = _quantiles(open_, {n: goal for n, (_, _, goal) in chosen.items()}, whole * target)
        side, new_first, new_count = F.lit(0), F.col("first"), F.col("count")
        for first, (_, left, _) in chosen.items():
            here = F.col("first") == first
            side = F.when(here, F.when(F.col("at") < cut[first], 1).otherwise(2)).otherwise(side)
        moved = nodes.withColumn("at", F.when(F.col("count") > 1, _position(dim))).withColumn("side", side)
        half = F.floor(F.col("count") / 2).cast("int")
        new_first = F.when(F.col("side") == 2, F.col("first") + half).otherwise(new_first)
        new_count = F.when(F.col("side") == 1, half).when(F.col("side") == 2, F.col("count") - half).otherwise(new_count)
        nodes = moved.withColumn("new_first", new_first).withColumn("count", new_count).withColumn("first", F.col("new_first")).drop("new_first", "at", "side")
        nodes = materialize(nodes, "nodes")
        width *= 2
    return _slots(nodes.select("id", "size", "crc", F.col("first").alias("shard"))).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _quantiles(rows: DataFrame, goals: dict[int, float], undivided: float) -> dict[int, int]:
    """For each node, the position below which about the given bytes lie; no cut is in a group of up to `undivided` bytes."""
    bits = DIM_BITS + CRC_BITS + TIE_BITS
    state = {n: (0, 0.0) for n in goals}  # the interval's start, and the bytes below it
    settled: dict[int, int] = {}
    while bits > 0:
        step = bits - TIE_BITS if 0 < bits - TIE_BITS < STEP_BITS else min(STEP_BITS, bits)
        bits -= step
        start = F.lit(None).cast("long")
        goal = F.lit(None).cast("double")
        for n, (lo, below) in state.items():
            start = F.when(F.col("first") == n, F.lit(lo).cast("long")).otherwise(start)
            goal = F.when(F.col("first") == n, F.lit(goals[n] - below)).otherwise(goal)
        inside = rows.withColumn("start", start).where(F.col("start").isNotNull() & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.lit(1 << (bits + step)).cast("long")))
        sums = inside.withColumn("k", F.shiftright(F.col("at") - F.col("start"), bits)).groupBy("first", "k").agg(F.sum("size").alias("bytes"))
        # At most 2 ** STEP_BITS sums a node, whatever the number of documents.
        w = Window.partitionBy("first").orderBy("k")
        run = sums.withColumn("upto", F.sum("bytes").over(w)).withColumn("goal", goal)
        hit = run.where("upto >= goal").groupBy("first").agg(F.min(F.struct("k", "upto", "bytes")).alias("h")).select("first", "h.*").collect()
        for r in hit:
            n, lo, below = r["first"], *state[r["first"]]
            state[n] = (lo + (r["k"] << bits), below + r["upto"] - r["bytes"])
            if bits == 0 or bits == TIE_BITS and r["bytes"] <= undivided:
                # One position, or one group of equal texts that may stay whole: cut at its nearer side.
                settled[n] = state[n][0] + (1 << bits if goals[n] - state[n][1] > r["bytes"] / 2 else 0)
        found = {r["first"] for r in hit}
        for n in list(state):
            if n in settled or n not in found:
                settled.setdefault(n, state[n][0])
                del state[n]
        if not state:
            break
    return settled


def _slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers in each shard: rows are numbered in small parts of a shard, each on from the parts before it."""
    parts = max(64, rows.count() // 50_000)  # about 2000 rows a shard and part
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "crc", F.lit(7)), F.lit(parts)))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size"))
    return rows.withColumn("own", own).join(before, ["shard", "part"]).withColumn("slot", (F.col("own") - 1 + F.col("base")).cast("long"))
