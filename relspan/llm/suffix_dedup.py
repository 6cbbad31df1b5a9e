"""Exact repeats of long byte strings, by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Of all suffixes only anchors are
sorted: positions whose q-gram hash is least in some window of WINDOW consecutive q-grams, of which every string of
LENGTH bytes has at least one, at the same place in each of its copies. The initial buckets are the anchors' q-grams;
buckets of one are done. An anchor's extent is all that the strings around it can reach: where extents of a bucket are
equal, all strings in them repeat. The others are refined by the bucket identifiers of later and earlier offsets: the
strings around an anchor start 0 to WINDOW - 1 bytes ahead of it, and a range of these starts has a core that all its
strings share. Members whose cores differ part for good, halves of the range are treated alike, down to single strings.
Buckets of up to BUCKET members are refined in one sorted pass at all offsets together; only larger ones are halved by
a shuffle on the new identifiers, until they are small or done, so no bucket is ever gathered whole.

Identifiers are 64-bit hashes of substrings; a bucket is told by its q-gram's and a string's own, 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from relspan.llm._store import join_counted, materialize
from relspan.llm._text import U64, Powers, Rolling, flat_bytes, give_back, mix, slices

GRAM = 128
#: Members up to which a bucket is refined in one task: 11 MB of extents and 35 MB of hashes.
BUCKET = 16_000
#: Members from which equal extents are common: with those of over a 2,000th of all anchors, 2,000 classes at most.
COMMON = 1000
#: Extents that are hashed at a time.
ROWS = 500
TOP = U64(2**64 - 1)


def sliding(values: np.ndarray, width: int, lowest: bool) -> np.ndarray:
    """Minimum (or maximum) of each run of `width` values: one result for each run's first value."""
    n = len(values)
    f, fill = (np.minimum, TOP) if lowest else (np.maximum, U64(0))
    blocks = np.full((-(-n // width) + 1) * width, fill, dtype=U64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).reshape(-1)
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(back[:n], ahead[width - 1 : n + width - 1])


def anchors(data: np.ndarray, off: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: each anchor's text, position in it, q-gram hash and hash of its extent."""
    n, window = len(data), length - GRAM + 1
    size = np.diff(off)
    if n < length or not (size >= length).any():
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
    rolling = Rolling(data, powers)
    grams = np.full(n, TOP, dtype=U64)
    grams[: n - GRAM + 1] = mix((rolling.sums[GRAM:] - rolling.sums[: n - GRAM + 1]) * rolling.down[: n - GRAM + 1]) | U64(1)
    least = sliding(grams, window, True)
    least[np.arange(n) + length > np.repeat(off[1:], size)] = 0  # no string of the full length starts here
    at = np.flatnonzero(sliding(least[::-1], window, False)[::-1] == grams)
    del least
    doc = np.searchsorted(off, at, side="right") - 1
    lo = np.maximum(at - window + 1, off[doc])
    hi = np.minimum(at + length, off[doc + 1])
    extent = mix(rolling(lo, hi) + (at - lo).astype(U64))
    return doc, at - off[doc], grams[at], extent


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs, in order, of the bytes that any span covers; touching runs are one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _removed(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    runs = merged(spans)
    parts, at = [], 0
    for s, e in runs:
        parts.append(data[at:s])
        at = e
    parts.append(data[at:])
    return sum(e - s for s, e in runs), len(runs), b"".join(parts)


_RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def _result_columns(rows: list[tuple[bytes, list[tuple[int, int]]]], texts: str | None) -> list[pa.Array]:
    n, removed, spans, digests, kept = [], [], [], [], []
    for data, own in rows:
        r, k, rest = _removed(data, own)
        n.append(len(data))
        removed.append(r)
        spans.append(k)
        digests.append(hashlib.sha256(rest).hexdigest())
        kept.append(None if texts is None else rest if texts == "bytes" else rest.decode(errors="ignore").encode())
    return [pa.array(c, type=t) for c, (_, t) in zip((n, removed, spans, digests, kept), _RESULT, strict=True)]


def _first(batches: Iterator[pa.RecordBatch], schema: pa.Schema, length: int, texts: str | None) -> Iterator[pa.RecordBatch]:
    """Texts with their anchors: a result where all is known (kind 0), else the text (1) and the extents to refine (2)."""
    window = length - GRAM + 1

    def block(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

    for b in slices(batches, "text"):
        texts_, marks = b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist()
        ready, rows, later, later_rows, own = [], [], [], [], {"k": [], "at": [], "left": [], "core": [], "extent": []}
        for i, (data, list_) in enumerate(zip(texts_, marks, strict=True)):
            data = data or b""
            known = [(max(0, m["a"] - window + 1), min(len(data), m["a"] + length)) for m in list_ or [] if m["done"]]
            need = [m for m in list_ or [] if m["need"]]
            if not need:
                ready.append(i)
                rows.append((data, known))
            else:
                later.append(i)
                later_rows.append((data, known))
            for m in need:
                lo = max(0, m["a"] - window + 1)
                own["k"].append(b.column(0)[i].as_py())
                own["at"].append(m["a"])
                own["left"].append(m["a"] - lo)
                own["core"].append(m["g"])
                own["extent"].append(data[lo : m["a"] + length])
        if ready:
            cols = dict(zip([n for n, _ in _RESULT], _result_columns(rows, texts), strict=True))
            yield block(len(ready), kind=pa.array([0] * len(ready), pa.int32()), k=b.column(0).take(pa.array(ready)), id=b.column(1).take(pa.array(ready)), rest=b.column(4).take(pa.array(ready)), **cols)
        if later:
            spans = pa.array([[{"s": s, "e": e} for s, e in merged(known)] for _, known in later_rows], type=schema.field("spans").type)
            yield block(len(later), kind=pa.array([1] * len(later), pa.int32()), k=b.column(0).take(pa.array(later)), id=b.column(1).take(pa.array(later)), rest=b.column(4).take(pa.array(later)), extent=pa.array([d for d, _ in later_rows], pa.binary()), spans=spans)
        if own["k"]:
            m = len(own["k"])
            yield block(m, kind=pa.array([2] * m, pa.int32()), **{n: pa.array(v, schema.field(n).type) for n, v in own.items()})


def _matrix(extents: list[bytes], left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extents laid out with their anchors in one column, and where each starts and ends there."""
    window = length - GRAM + 1
    width = window - 1 + length
    data = np.zeros((len(extents), width), dtype=np.uint8)
    start = window - 1 - left
    size = np.array([len(x) for x in extents])
    flat = np.frombuffer(b"".join(extents), dtype=np.uint8)
    cols = np.arange(width)
    data[(cols >= start[:, None]) & (cols < (start + size)[:, None])] = flat
    return data, start, start + size


def _string_hashes(data: np.ndarray, ahead: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Hashes of the strings that start `ahead` bytes before the anchor (rows: extents)."""
    n, width = data.shape
    rolling = Rolling(data.reshape(-1), powers)
    start = (np.arange(n) * width)[:, None] + (length - GRAM - ahead)[None, :]
    return rolling(start, start + length)


def _refine(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings in buckets that follow each other, sorted by bucket: (k, s, e)."""
    powers = Powers()
    window = length - GRAM + 1
    ahead = np.arange(window)
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        core = rows["core"].to_numpy()
        left, at = rows["left"].to_numpy(), rows["at"].to_numpy()
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        extents, group = rows["extent"].to_pylist(), mix(core.view(U64)) * U64(3)
        keys, ok = np.zeros((len(core), window), dtype=U64), np.zeros((len(core), window), dtype=bool)
        first = window - 1 - ahead
        for at_row in range(0, len(core), ROWS):
            some = slice(at_row, at_row + ROWS)
            data, start, end = _matrix(extents[some], left[some], length)
            keys[some] = mix(_string_hashes(data, ahead, length, powers) + group[some, None] + ahead.astype(U64))
            ok[some] = (first >= start[:, None]) & (first + length <= end[:, None]) & (ahead >= x[some, None]) & (ahead < y[some, None])
        found = np.zeros((len(core), window + 2), dtype=np.int8)
        for lo in range(0, window, 32):
            part = ok[:, lo : lo + 32]
            own = keys[:, lo : lo + 32][part]
            order = np.argsort(own)
            same = own[order][1:] == own[order][:-1]
            twice = np.zeros(len(own), dtype=bool)
            twice[1:] |= same
            twice[:-1] |= same
            again = np.zeros(len(own), dtype=bool)
            again[order] = twice
            found[:, 1 + lo : 1 + lo + part.shape[1]][part] = again
        edge = np.diff(found, axis=1)
        r, lo = np.nonzero(edge == 1)  # from this many bytes ahead
        _, hi = np.nonzero(edge == -1)  # to one less than this many
        return pa.RecordBatch.from_arrays([rows["k"].combine_chunks().take(pa.array(r)), pa.array((at[r] - hi + 1).astype(np.int64)), pa.array((at[r] - lo + length).astype(np.int64))], ["k", "s", "e"])

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        if not held:
            return
        rows = pa.Table.from_batches(held)
        core = rows["core"].to_numpy()
        stop = len(core) if last else int(np.flatnonzero(core != core[-1])[-1]) + 1 if (core != core[-1]).any() else 0
        lo = 0
        while lo < stop:
            hi = min(stop, lo + 2000)
            while hi < stop and core[hi] == core[hi - 1]:
                hi += 1
            yield done(rows.slice(lo, hi - lo))
            lo = hi
        held = rows.slice(stop).combine_chunks().to_batches() if stop < len(core) else []

    give_back()
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) > 4000:
            yield from flush(False)
    yield from flush(True)
    give_back()


def _halve(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each extent under both halves of its range of starts, with the halves' identifiers."""
    powers = Powers()
    window = length - GRAM + 1
    for b in batches:
        if not b.num_rows:
            continue
        left, size = b.column("left").to_numpy(), np.array([len(v) for v in b.column("extent").to_pylist()])
        core, x, y = b.column("core").to_numpy(), b.column("x").to_numpy(), b.column("y").to_numpy()
        data, start, end = _matrix(b.column("extent").to_pylist(), left, length)
        n, width = data.shape
        rolling = Rolling(data.reshape(-1), powers)
        base = np.arange(n) * width + window - 1
        for lo, hi in ((x, (x + y) // 2), ((x + y) // 2, y)):
            # Starts that lie in the text: at most `left` bytes ahead, and the string ends within the extent.
            low, high = np.maximum(lo, length - (size - left)), np.minimum(hi - 1, left)
            ok = np.flatnonzero(low <= high)
            s = base[ok]
            inner = mix(rolling(s - lo[ok], s - hi[ok] + 1 + length) + mix(core[ok].view(U64) + lo[ok].astype(U64) * U64(1000) + hi[ok].astype(U64)))
            outer = mix(rolling(s - high[ok], s - low[ok] + length) + (high[ok] - lo[ok]).astype(U64) * U64(7919))
            rows = b.take(pa.array(ok))
            new = {"core": inner.view(np.int64), "x": lo[ok].astype(np.int32), "y": hi[ok].astype(np.int32), "low": low[ok].astype(np.int32), "high": high[ok].astype(np.int32), "outer": outer.view(np.int64)}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else rows.column(f.name) for f in schema], schema=schema)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", texts: str | None = "bytes", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept, rest) for every row of docs.

    Every byte of a text (UTF-8; null: empty) that a string of `length` bytes covers which also starts anywhere else,
    in the same text or another, is removed; strings are those of the input and never cross texts. n_spans counts
    maximal removed runs, kept holds the other bytes in order, kept_sha256 their digest. With texts "text" kept leaves
    out characters that a cut went through, so it is UTF-8 again; with None it is null. rest is a struct of the `carry`
    columns of the row. Texts shorter than `length` are kept whole. Repeated rows are copies of each other, null and
    repeated ids are carried along, other columns are ignored, an empty table gives no rows. length is at least 256.
    A task holds a few MB of text at a time, a longer text alone: about 100 bytes of memory for each byte of it.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    window = length - GRAM + 1
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*carry, F.lit(0).alias("_")).alias("rest"))
    kept = kept.select(F.xxhash64("id", "text").alias("k"), "id", "text", "rest")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in slices(batches, "text"):
            doc, at, gram, extent = anchors(*flat_bytes(b.column(1)), length, powers)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(extent.view(np.int64))], ["k", "a", "g", "c"])

    every = materialize(kept.select("k", "text").mapInArrow(find, "k long, a int, g long, c long"), "anchors")
    # Initial buckets of two anchors at least; whether all their extents are equal.
    buckets = every.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    buckets = materialize(buckets.select("g", "n", (F.col("lo") < F.col("hi")).alias("mixed")), "buckets")
    total = every.count()
    shared = materialize(join_counted(every, buckets, ["g"], total).drop("n"), "shared")
    # In mixed buckets: equal extents repeat, and one of them stands for all.
    equal = shared.where("mixed").groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k", "a")).alias("rep"))
    equal = materialize(equal, "equal")
    common, rare = F.col("n") > max(COMMON, total // 2000), F.col("n") <= max(COMMON, total // 2000)
    mark = lambda done, need: F.struct("a", "g", done.alias("done"), need.alias("need")).alias("m")
    mixed, own = shared.where("mixed").drop("mixed"), F.concat_ws(":", "g", "c")
    same = F.col("rep") == F.struct("k", "a")
    names = [row[0] for row in equal.where(common).select(own).collect()]
    if names:  # rows of common classes are told by their identifiers, so no task gathers them
        told = own.isin(names)
        marks = mixed.where(~told).join(equal.where(rare), ["g", "c"]).select("k", mark(F.col("n") > 1, (F.col("n") == 1) | same))
        marks = marks.union(mixed.where(told).select("k", mark(F.lit(True), F.lit(False))))
        marks = marks.union(equal.where(common).select("g", "rep.*").select("k", mark(F.lit(True), F.lit(True))))
    else:
        marks = mixed.join(equal, ["g", "c"]).select("k", mark(F.col("n") > 1, (F.col("n") == 1) | same))
    marks = marks.union(shared.where("not mixed").select("k", mark(F.lit(True), F.lit(False))))
    marks = marks.distinct().groupBy("k").agg(F.collect_list("m").alias("marks"))  # as many as the text has anchors

    span = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    result = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType()), ("rest", kept.schema["rest"].dataType)]
    fields = [("kind", T.IntegerType()), ("k", T.LongType()), ("id", T.LongType()), *result, ("spans", span), ("at", T.IntegerType()), ("left", T.IntegerType()), ("core", T.LongType()), ("extent", T.BinaryType())]
    sql = T.StructType([T.StructField(n, t) for n, t in fields])
    schema = pa.schema([(n, to_arrow_type(t)) for n, t in fields])
    first = materialize(kept.join(marks, "k", "left").select("k", "id", "text", "marks", "rest").mapInArrow(lambda it: _first(it, schema, length, texts), sql), "first")

    rest = first.where("kind = 2").select("k", "at", "left", "core", "extent", F.lit(0).alias("x"), F.lit(window).alias("y"))
    sql = "k long, at int, left int, core long, extent binary, x int, y int"
    arrow = pa.schema([("k", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("core", pa.int64()), ("extent", pa.binary()), ("x", pa.int32()), ("y", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("outer", pa.int64())])
    spans = []
    while True:
        large = rest.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("core")
        large = materialize(large, "large")
        few = rest if large.isEmpty() else rest.join(large, "core", "left_anti")
        few = few.select("k", "at", "left", "core", "extent", "x", "y").repartition("core").sortWithinPartitions("core")
        spans.append(few.mapInArrow(lambda it: _refine(it, length), "k long, s long, e long"))
        if large.isEmpty():
            break
        halves = rest.join(large, "core", "left_semi").select("k", "at", "left", "core", "extent", "x", "y").mapInArrow(lambda it: _halve(it, length, arrow), sql + ", low int, high int, outer long")
        halves = materialize(halves, "halves")
        cores = halves.groupBy("core").agg(F.count("*").alias("members")).where("members > 1")
        outers = halves.groupBy("core", "outer").agg(F.count("*").alias("n"), F.min(F.struct("k", "at")).alias("rep"))
        known = join_counted(halves.join(cores.select("core"), "core", "left_semi"), materialize(outers, "outers"), ["core", "outer"], halves.count())
        spans.append(known.where("n > 1").select("k", (F.col("at") - F.col("high")).cast("long").alias("s"), (F.col("at") - F.col("low") + length).cast("long").alias("e")))
        more = known.where((F.col("n") == 1) | (F.col("rep") == F.struct("k", "at"))).where("y - x > 1").select("k", "at", "left", "core", "extent", "x", "y").dropDuplicates(["k", "at", "core"])
        rest = materialize(more, "rest")
    found = spans[0]
    for s in spans[1:]:
        found = found.union(s)
    found = found.groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("found"))

    out_sql = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(n, t) for n, t in result)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "extent"):
            rows = []
            for data, a, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                rows.append((data, [(max(0, x["s"]), min(len(data), x["e"])) for x in [*(a or []), *(c or [])]]))
            yield pa.RecordBatch.from_arrays([b.column(0), *_result_columns(rows, texts), b.column(4)], [f.name for f in out_sql])

    pending = first.where("kind = 1").select("k", "id", "extent", "spans", "rest").join(found, "k", "left").select("id", "extent", "spans", "found", "rest")
    late = pending.mapInArrow(finish, out_sql)
    columns = out_sql.names
    return first.where("kind = 0").select(*columns).union(late.select(*columns)).withColumnRenamed("id", id_col)
