"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: sigma scatters a document's shingles over a 32-bit circle, and
coordinate k is the least value of pi over the shingles after the circle is turned by k. Bands of coordinates put
documents in buckets. A bucket's members are first compared with its smallest member only; links found so far join
members into components, and only buckets that still hold several components look further: all pairs between these are
compared in place by a byte of many signature coordinates each, and those that agree well enough are candidates; buckets
too large for one task are cut into blocks, and each pair of blocks is a cell that is compared alike. Every link is
confirmed on the two documents' whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._graph import components
from relspan.llm._store import materialize
from relspan.llm._text import NOT_SPACE, Powers, flat_bytes, give_back, mix, slices, words

U64, U32 = np.uint64, np.uint32
SHINGLE = 5
#: 48 bands of 5 coordinates: two sets of similarity 0.75 share no band with a probability of 2.3e-6.
BANDS, ROWS = 48, 5
#: Members up to which a bucket is one cell (by 880 bytes a member); larger ones are cut into blocks of half as many.
SMALL_BUCKET = 4096
#: In buckets of over MANY blocks these grow, up to BLOCK_MOST members.
MANY, BLOCK_MOST = 16, 16_384
#: Coordinates of which a byte each is kept, and how many of these agree at least: 4.5 deviations below similarity 0.75.
BRIEF, AGREE = BANDS * ROWS, 150
#: Bytes of an odd sketch: bit i tells whether an odd number of shingles have hash i. Two sketches differ in no more
#: bits than the sets have shingles that are not shared, so too many bits rule a pair out for certain.
ODD = 256


def shingle_sets(data: np.ndarray, off: np.ndarray, powers: Powers, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and their offsets (n + 1).

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    h, _, _, first = words(data, off, NOT_SPACE, powers)
    counts = np.diff(first)
    n = len(h)
    sh = np.zeros(n, dtype=U64)
    left = np.repeat(first[1:], counts) - np.arange(n)  # words from here to the text's end
    for j in range(size):
        ok = np.flatnonzero(left > j)
        sh[ok] = mix(sh[ok] * U64(0x9E3779B97F4A7C15) + h[ok + j] + U64(j + 1))
    use = left >= size
    start = first[:-1][(counts > 0) & (counts < size)]
    use[start] = True
    doc = np.repeat(np.arange(len(counts)), counts)[use]
    sh = sh[use]
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def signatures(sets: np.ndarray, off: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash signatures (rows: coordinates, columns: the non-empty sets)."""
    start = off[:-1][off[:-1] < off[1:]]
    out = np.zeros((coordinates, len(start)), dtype=U32)
    if not len(start):
        return out
    sigma = (mix(sets ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(U32)
    x, t = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(coordinates):
        # pi: a permutation of the circle, by odd products and shifted exclusive ors.
        np.add(sigma, U32(k), out=x)
        np.multiply(x, U32(0x9E3779B1), out=x)
        np.right_shift(x, U32(15), out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, U32(0x85EBCA77), out=x)
        np.right_shift(x, U32(13), out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, U32(0xC2B2AE3D), out=x)
        np.minimum.reduceat(x, start, out=out[k])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band (columns: bands)."""
    out = np.zeros((signature.shape[1], bands), dtype=U64)
    for b in range(bands):
        h = np.full(signature.shape[1], b + 1, dtype=U64)
        for r in range(rows):
            h = mix(h * U64(0x9E3779B97F4A7C15) + signature[b * rows + r])
        out[:, b] = h
    return out


def _parities(bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Odd sketches (rows) of sets end to end whose members have the given bits."""
    count = np.bincount(np.repeat(np.arange(len(sizes)) * (8 * ODD), sizes) + bits, minlength=len(sizes) * 8 * ODD)
    return np.packbits((count & 1).astype(np.uint8)).reshape(len(sizes), ODD)


def _sketch(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for b in slices(batches, "text"):
        sets, off = shingle_sets(*flat_bytes(b.column(1)), powers)
        n = np.diff(off)
        some = n > 0
        sums = [np.zeros(len(n), dtype=U64) for _ in range(2)]
        if len(sets):
            for s, seed in zip(sums, (0x1B873593, 0xCC9E2D51), strict=True):
                s[some] = np.add.reduceat(mix(sets ^ U64(seed)), off[:-1][some])
        signature = signatures(sets, off, bands * rows)
        keys = band_keys(signature, bands, rows).view(np.int64)
        bits = (mix(sets ^ U64(0x2545F4914F6CDD1D)) % U64(8 * ODD)).astype(np.int64)
        odd = np.concatenate([_parities(bits[off[at] : off[min(at + 64, len(n))]], n[at : at + 64]) for at in range(0, len(n), 64)])[some]
        brief, at = np.concatenate([signature[:BRIEF].astype(np.uint8).T, odd], axis=1), np.cumsum(some) - 1
        briefs = pa.array([brief[i].tobytes() if ok else None for i, ok in zip(at.tolist(), some.tolist(), strict=True)], pa.binary())
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), flat, briefs], ["doc", "n", "f1", "f2", "bands", "brief"])


def _between(batches: Iterator[pa.RecordBatch], percent: int, agree: int) -> Iterator[pa.RecordBatch]:
    """Pairs between components of cells that follow each other, sorted, of about one size and enough agreeing coordinates.

    A pair comes from the bucket of its first common band only. Of a cell of two blocks only pairs between these count.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, rep, n, component = (rows[c].to_numpy() for c in ("bucket", "rep", "n", "component"))
        block = rows["block"].to_numpy()
        brief = np.frombuffer(b"".join(rows["brief"].to_pylist()), dtype=np.uint8).reshape(len(rep), BRIEF + ODD)
        brief, odd = brief[:, :BRIEF], np.ascontiguousarray(brief[:, BRIEF:]).view(U64)
        few = np.ascontiguousarray(odd[:, : ODD // 32])
        band = rows["band"].to_numpy()
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            two = block[lo:hi].min() < block[lo:hi].max()
            for at in range(lo, hi, 64):
                some = slice(at, min(at + 64, hi))
                ok = component[some, None] != component[None, lo:hi]
                ok &= rep[some, None] < rep[None, lo:hi]
                ok &= 100 * np.minimum(n[some, None], n[None, lo:hi]) >= percent * np.maximum(n[some, None], n[None, lo:hi])
                if two:
                    ok &= block[some, None] != block[None, lo:hi]
                i, j = np.nonzero(ok)
                for part in range(0, len(i), 1 << 13):
                    x, y = i[part : part + (1 << 13)] + at, j[part : part + (1 << 13)] + lo
                    for bits in (few, odd):  # the first of the bits alone rule most pairs out
                        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                        maybe = apart * (100 + percent) <= (100 - percent) * (n[x] + n[y])
                        x, y = x[maybe], y[maybe]
                    if agree:
                        near = (brief[x] == brief[y]).sum(axis=1) >= agree
                        x, y = x[near], y[near]
                    first = ~(bands[x, : band[lo]] == bands[y, : band[lo]]).any(axis=1)
                    if first.any():
                        yield pa.RecordBatch.from_arrays([pa.array(rep[x[first]]), pa.array(rep[y[first]])], ["u", "v"])

    held: list[pa.RecordBatch] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        if held:
            rows = pa.Table.from_batches(held)
            bucket = rows["bucket"].to_numpy()
            other = np.flatnonzero(bucket != bucket[-1])
            stop = len(bucket) if last else int(other[-1]) + 1 if len(other) else 0
            held = rows.slice(stop).combine_chunks().to_batches() if stop < len(bucket) else []
            if stop:
                yield from pairs(rows.slice(0, stop))

    give_back()
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) > 10_000:
            yield from flush(False)
    yield from flush(True)
    give_back()


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, a, b) whose texts a and b are similar enough; a text that comes again right away is not cut up again."""
    powers = Powers()
    for b in slices(slices(batches, "a", 1 << 20), "b", 1 << 20):
        keep, column = [], {}
        for name in ("a", "b"):
            texts = b.column(name).dictionary_encode()
            sets, off = shingle_sets(*flat_bytes(texts.dictionary), powers)
            column[name] = (sets, off, texts.indices.to_numpy(zero_copy_only=False))
        (sa, oa, ia), (sb, ob, ib) = column["a"], column["b"]
        for i in range(b.num_rows):
            x, y = sa[oa[ia[i]] : oa[ia[i] + 1]], sb[ob[ib[i]] : ob[ib[i] + 1]]
            if len(x) > len(y):
                x, y = y, x
            if not len(x) or 100 * len(x) < percent * len(y):
                continue
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        yield b.select(["u", "v"]).take(pa.array(keep, type=pa.int64()))


class _Buckets:
    """The candidate search over the representatives of one table."""

    def __init__(self, reps: DataFrame, texts: DataFrame, percent: int, agree: int = AGREE) -> None:
        self.reps, self.texts, self.percent, self.agree = reps, texts, percent, agree
        self.links = self.texts_of = None
        self.labels = None

    def stars(self, buckets: DataFrame) -> DataFrame:
        """Pairs of a bucket's smallest member with each other one of about its size."""
        center = buckets.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("c"))
        return self.sized(buckets.join(center, "bucket").select(F.col("c.rep").alias("u"), F.col("rep").alias("v"), F.col("c.n").alias("nu"), F.col("n").alias("nv")))

    def sized(self, pairs: DataFrame) -> DataFrame:
        ok = (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * self.percent) & (F.col("u") < F.col("v"))
        return pairs.where(ok).select("u", "v").distinct()

    def confirm(self, pairs: DataFrame) -> DataFrame:
        t = self.texts_of
        both = pairs.join(t.select(F.col("doc").alias("v"), F.col("text").alias("b")), "v").join(t.select(F.col("doc").alias("u"), F.col("text").alias("a")), "u")
        percent = self.percent
        return both.select("u", "v", "a", "b").mapInArrow(lambda it: _verify(it, percent), "u long, v long")

    def add(self, pairs: DataFrame) -> None:
        new = self.confirm(pairs)
        self.links = materialize(new if self.links is None else self.links.union(new), "links")
        self.labels = components(self.links)

    def unsettled(self, buckets: DataFrame) -> DataFrame:
        """Members, with their components, of the buckets that hold more than one component."""
        named = buckets.join(self.labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        state = named.groupBy("bucket").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        return named.join(state.select("bucket", "members"), "bucket")

    def run(self) -> DataFrame:
        """(node, component) of all representatives that are linked."""
        rows = self.reps.select("rep", "n", F.posexplode("bands")).select("rep", "n", F.col("pos").alias("band"), F.xxhash64("pos", "col").alias("bucket"))
        shared = rows.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
        buckets = materialize(rows.join(shared, "bucket", "left_semi"), "buckets")
        members = buckets.select("rep").distinct().withColumnRenamed("rep", "doc")
        # A representative's text: rows that share its id may hold another text; all are compared.
        self.texts_of = materialize(self.texts.join(members, "doc", "left_semi").distinct(), "texts")
        self.add(self.stars(buckets))
        rest = materialize(self.unsettled(buckets), "unsettled")
        if rest.isEmpty():
            return self.labels
        half = max(1, SMALL_BUCKET // 2)
        blocks = F.when(F.col("members") <= SMALL_BUCKET, F.lit(1)).otherwise(F.greatest(F.least(F.ceil(F.col("members") / half), F.lit(MANY)), F.ceil(F.col("members") / BLOCK_MOST)))
        cut = rest.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cell = F.when(F.col("blocks") > 1, F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))).otherwise(F.col("bucket"))
        near = cut.select(cell.alias("bucket"), "rep", "n", "component", "band", "block").join(self.reps.select("rep", "brief", "bands"), "rep")
        percent, agree = self.percent, self.agree
        self.add(near.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _between(it, percent, agree), "u long, v long").distinct())
        return self.labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, agree: int = AGREE) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if 100 * shared shingles >= percent * all shingles of the two; component_id is the smallest
    id reachable by links, and the row of that id is kept. Texts without words (null and empty ones too) have no
    shingles and are linked with nothing: each is its own component. Rows that share an id are one document with all
    their links. Rows with a null id take part under no id: they are a component of their own (component_id null) and
    are kept. Other columns are ignored. Equal shingle sets are collapsed ahead of the search, so copies cost one row.
    Two documents of a common band that agree in under `agree` of 240 coordinates are not compared; with 0 all are,
    but those whose odd sketches prove them too different.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sketch = kept.mapInArrow(lambda it: _sketch(it, BANDS, ROWS), "doc long, n long, f1 long, f2 long, bands array<long>, brief binary")
    sketch = materialize(sketch, "sketch")
    sets = sketch.where("n > 0 and doc is not null").groupBy("f1", "f2", "n").agg(F.min("doc").alias("rep"))
    sets = materialize(sets, "sets")
    key = ["f1", "f2", "n"]
    reps = sketch.where("doc is not null").join(sets.withColumnRenamed("rep", "doc"), [*key, "doc"], "left_semi").select(F.col("doc").alias("rep"), "n", "bands", "brief")
    # One row an id and set, however often the row is repeated.
    reps = reps.dropDuplicates(["rep", "bands"])
    labels = _Buckets(reps, kept.where("doc is not null"), percent, agree).run()

    # Rows that share an id, or a set, are joined: an edge from each id to its set's representative where they differ.
    row = sketch.select("doc", *key).join(sets, key, "left")
    shared = row.where("rep is not null").groupBy("doc").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    if not shared.isEmpty():
        more = row.join(shared.select("doc"), "doc", "left_semi").where("rep is not null").select(F.col("doc").alias("u"), F.col("rep").alias("v"))
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    named = row.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = named.select(F.col("doc"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True))).withColumnRenamed("doc", id_col)
