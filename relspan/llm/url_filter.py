"""URL filter by a sort-merge range join of reversed-host keys and rules.

The key of a host is its labels in reverse, each followed by a dot ("www.example.org" -> "org.example.www."), so a
rule's host and all its subdomains are exactly the keys that start with the rule's key: one interval in sorted order,
and two such intervals are nested or disjoint. Urls and rules are range-partitioned by key on bounds taken from the
urls' keys; a rule goes to every range its interval meets. Each range is sorted, rules ahead of urls, and swept once:
a stack holds the rules whose interval is open, and a url asks only those. Many urls of one host spread over all
ranges that start with that key. Ranges are found by binary search in the bounds, of which there are few.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Urls in one range, ranges at most (they are sorted and swept row by row, whatever their size), and keys looked at for
#: each range bound: about 160,000 keys of hosts at most reach the driver.
RANGE_ROWS, RANGES_MOST = 1_000_000, 4096
BOUND_KEYS = 40

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or url."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """The stack of open rules at one place of the sorted order."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def leave(self, key: str) -> None:
        """Close every rule whose interval ended ahead of key."""
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, action: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        if path not in paths or action == "block":
            paths[path] = (host + path, action)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def verdict(self, path: str) -> tuple[str, str] | None:
        """Of the open rules whose path starts the url's: the longest; of equally long ones that of the longest host."""
        best = None
        for _, paths, lengths in self.stack:
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])) is not None:
                    if best is None or len(hit[0]) >= len(best[0]):
                        best = hit
                    break
        return best


def _sweep(batches: Iterator[pa.RecordBatch], schema: pa.Schema, default: str) -> Iterator[pa.RecordBatch]:
    sweep, at, last = Sweep(), None, None
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("part", "key", "kind", "host", "path", "action")}
        keep, rules, verdicts = [], [], []
        for i, (part, key, kind, host, path, action) in enumerate(zip(*c.values(), strict=True)):
            if part != at:
                sweep, at = Sweep(), part
                last = None
            if key != last:
                sweep.leave(key)
                last = key
            if kind == 0:
                sweep.open(key, host, path, action)
                continue
            hit = sweep.verdict(path) or (None, default)
            keep.append(i)
            rules.append(hit[0])
            verdicts.append(hit[1])
        out = batch.select(["id", "host", "path"]).take(pa.array(keep, type=pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rules, type=pa.string()), pa.array(verdicts, type=pa.string())], schema=pa.schema([out.schema.field(0), *list(schema)[1:]]))


def _ranges(batches: Iterator[pa.RecordBatch], bounds: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (key, spread, ...) with their range in the place of the latter: rows of a key that is a bound, even several
    times over, are dealt by `spread` to all ranges that this key starts, so a hot host is in many."""
    for batch in batches:
        keys = batch.column(0).dictionary_encode()
        places = [(bisect_left(bounds, k), bisect_right(bounds, k)) for k in keys.dictionary.to_pylist()]
        low, high = np.array(places, dtype=np.int64).reshape(-1, 2)[keys.indices.to_numpy(zero_copy_only=False)].T
        part = low + batch.column(1).to_numpy().astype(np.uint64) % (high - low + 1).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part.astype(np.int32)), *batch.columns[2:]], ["key", "part", *batch.schema.names[2:]])


def _meets(batches: Iterator[pa.RecordBatch], bounds: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ...) with the ranges that keys which start with this key are in."""
    for batch in batches:
        parts = []
        for k in batch.column(0).to_pylist():
            low, high = bisect_left(bounds, k), bisect_right(bounds, k)
            while high < len(bounds) and bounds[high].startswith(k):
                high += 1
            parts.append(list(range(low, high + 1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int32())), *batch.columns[1:]], ["key", "parts", *batch.schema.names[1:]])


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages, repeated rows and null ids included.

    rules has host, path and action (allow or block). A rule fits its host and all subdomains if the url's path starts
    with the rule's path; the longest fitting rule (host and path together) wins, of two equally long ones that with
    the longer host, and block wins over allow for the same host and path. Null or empty rule hosts fit nothing; a null
    rule path is empty. Where no rule fits, rule is null and verdict is `default`. Any other columns are ignored.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host")))
    rule = rules.select(F.translate("host", UPPER, UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").where("host <> ''").withColumn("key", host_key(F.col("host")))

    n = pages.count()
    ranges = min(RANGES_MOST, max(spark.sparkContext.defaultParallelism, ceil(n / RANGE_ROWS))) if n else 1
    every = max(1, n // (ranges * BOUND_KEYS))
    keys = sorted(r.key for r in urls.select("key", F.xxhash64("id", "path").alias("h")).where(F.pmod("h", F.lit(every)) == 0).select("key").limit(3 * ranges * BOUND_KEYS).collect())
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    shared = spark.sparkContext.broadcast(bounds)
    kind = urls.schema["id"].dataType.simpleString()
    placed = urls.select("key", F.xxhash64("id", "path").alias("spread"), "id", "host", "path")
    urls = placed.mapInArrow(lambda it: _ranges(it, shared.value), f"key string, part int, id {kind}, host string, path string")
    rule = rule.select("key", "host", "path", "action").mapInArrow(lambda it: _meets(it, shared.value), "key string, parts array<int>, host string, path string, action string")
    rule = rule.withColumn("part", F.explode("parts")).drop("parts")

    both = urls.select("part", "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("action")).unionByName(
        rule.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["id"].dataType).alias("id"), "host", "path", "action")
    )
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    swept = both.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(lambda it: _sweep(it, schema, default), f"id {kind}, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)
