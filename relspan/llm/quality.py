"""Quality classifier: histogram gradient-boosted trees over statistics of the text alone.

Statistics of all documents are made first, in one pass without a shuffle, and written out. The trees are fitted on a
bounded sample of the labelled ones, then flattened into arrays of features, thresholds and children; scoring walks
all documents of a batch down all trees by array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspan.llm._store import materialize, small
from relspan.llm._text import NOT_SPACE, U64, Powers, Rolling, flat_bytes, slices, words

#: Labelled documents that the trees are fitted on at most: those of the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 4, 0.15, 64, 8, 1.0

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "space": (0x20, 0x09, 0x0B, 0x0C, 0x0D),
    "newline": (0x0A,),
    "stop": (0x2E, 0x2C, 0x3B, 0x3A),
    "bang": (0x21, 0x3F),
    "pipe": (0x7C, 0x5F, 0x7E, 0x5C),
    "symbol": (0x23, 0x24, 0x25, 0x26, 0x2A, 0x40, 0x5E, 0x2B, 0x3D, 0x3C, 0x3E),
    "bracket": (0x28, 0x29, 0x5B, 0x5D, 0x7B, 0x7D, 0x2F),
    "quote": (0x22, 0x27, 0x60, 0x2D),
    "high": range(0x80, 0x100),
}
CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    CLASS_OF[list(_members)] = _i
STATISTICS = [*_CLASSES, "log_bytes", "log_words", "word_length", "long_words", "distinct_words", "top_word", "repeated_pairs", "log_lines", "line_length", "repeated_lines", "upper_words", "symbol_words", "entropy"]


def statistics(data: np.ndarray, off: np.ndarray, powers: Powers) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    n = len(off) - 1
    out = np.zeros((n, len(STATISTICS)))
    at = {name: i for i, name in enumerate(STATISTICS)}
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    k = len(_CLASSES) + 1
    kinds = CLASS_OF[data]
    counts = np.bincount(doc * k + kinds, minlength=n * k).reshape(n, k)
    out[:, : k - 1] = counts[:, : k - 1] / np.maximum(size, 1)[:, None]
    out[:, at["log_bytes"]] = np.log1p(size)

    h, s, e, first = words(data, off, NOT_SPACE, powers)
    nw = np.diff(first)
    out[:, at["log_words"]] = np.log1p(nw)
    if len(h):
        some, each = nw > 0, np.maximum(nw, 1)
        start = first[:-1][some]
        length = e - s
        mean = lambda x: np.add.reduceat(x.astype(np.float64), start) / nw[some]
        out[some, at["word_length"]] = mean(length)
        out[some, at["long_words"]] = mean(length > 20)
        out[some, at["upper_words"]] = mean((kinds[s] == 0) & (kinds[np.minimum(s + 1, len(data) - 1)] == 0))
        out[some, at["symbol_words"]] = mean(np.isin(kinds[e - 1], (6, 7, 8, 9)))
        owner = np.repeat(np.arange(n), nw)
        order = np.lexsort((h, owner))
        sh, so = h[order], owner[order]
        new = np.ones(len(sh), dtype=bool)
        new[1:] = (sh[1:] != sh[:-1]) | (so[1:] != so[:-1])
        run = np.diff(np.append(np.flatnonzero(new), len(sh)))
        out[:, at["distinct_words"]] = np.bincount(so[new], minlength=n) / each
        top = np.zeros(n)
        np.maximum.at(top, so[new], run)
        out[:, at["top_word"]] = top / each
        part = run / each[so[new]]
        out[:, at["entropy"]] = np.bincount(so[new], weights=-part * np.log(part), minlength=n) / np.log1p(each)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair, po = h[inner] * U64(0x9E3779B97F4A7C15) + h[inner + 1], owner[inner]
        order = np.lexsort((pair, po))
        pair, po = pair[order], po[order]
        again = (pair[1:] == pair[:-1]) & (po[1:] == po[:-1])
        out[:, at["repeated_pairs"]] = np.bincount(po[1:][again], minlength=n) / each

    # Lines: between line feeds and the text's ends.
    feed = np.flatnonzero(data == 0x0A)
    filled = off[:-1][size > 0]
    ls = np.sort(np.concatenate([filled, feed + 1]))
    stops = off[1:][size > 0]
    le = np.sort(np.concatenate([feed, stops]))
    keep = le > ls
    ls, le = ls[keep], le[keep]
    lo = np.searchsorted(off, ls, side="right") - 1
    lines = np.bincount(lo, minlength=n)
    out[:, at["log_lines"]] = np.log1p(lines)
    out[:, at["line_length"]] = np.log1p(size / np.maximum(lines, 1))
    if len(ls):
        lh = Rolling(data, powers)(ls, le)
        order = np.lexsort((lh, lo))
        lh, lo = lh[order], lo[order]
        again = (lh[1:] == lh[:-1]) & (lo[1:] == lo[:-1])
        out[:, at["repeated_lines"]] = np.bincount(lo[1:][again], minlength=n) / np.maximum(lines, 1)
    return out


@dataclass
class Trees:
    """Complete trees of one depth: node i of a tree has children 2 i + 1 and 2 i + 2; a row goes right if its value is above the threshold."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1]
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost trees of logistic loss on quantile bins. Without rows every score is 0.5; with one class only, the smoothed rate."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    none = Trees(base, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    total = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        f, t, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            own = node - first
            best = np.full(count, 1e-9)
            bin_of = np.full(count, BINS, dtype=np.int64)
            for j in range(x.shape[1]):
                at = own * BINS + binned[:, j]
                sg = np.bincount(at, weights=g, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                sh = np.bincount(at, weights=h, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                sn = np.bincount(at, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                gt, ht, nt = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                gain = sg**2 / (sh + RIDGE) + (gt - sg) ** 2 / (ht - sh + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(sn < LEAST_ROWS) | (nt - sn < LEAST_ROWS)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best = np.where(better, gain[np.arange(count), top], best)
                bin_of = np.where(better, top, bin_of)
                f[first : first + count][better] = j
            for q in range(count):
                c = cuts[f[first + q]]
                if bin_of[q] < len(c):
                    t[first + q] = c[bin_of[q]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        own = node - inner
        step = RATE * np.bincount(own, weights=g, minlength=leaves) / (np.bincount(own, weights=h, minlength=leaves) + RIDGE)
        total += step[own]
        features.append(f)
        thresholds.append(t)
        values.append(step)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def held_out(id_column: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text has the given remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for b in slices(batches, "text"):
        x = statistics(*flat_bytes(b.column(1)), powers).astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], type=pa.binary())], ["id", "x"])


def _learn(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, mod: int, rest: int):
    """The fields of Trees, on all executors, from measured rows (id, x) and their labels."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.round(F.avg("y")).alias("y"))
    sample = rows.where(~held_out(F.col("id"), mod, rest)).join(own, "id").orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE_ROWS).collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in sample), dtype=np.float32).reshape(len(sample), len(STATISTICS)).astype(np.float64)
    return rows.sparkSession.sparkContext.broadcast(vars(fit(x, np.array([r.y for r in sample], dtype=np.float64))))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 4, rest: int = 2, limit: float = 0.7) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs; score is the chance of label 1, predicted whether it reaches `limit`.

    Labels are learned from rows whose crc32(id) % mod is not rest. Null and empty texts have statistics of zero and a
    score like any other. Null labels and labels without a document are not learned from; several labels of one id
    count by their mean, rounded. Without any label the score is 0.5. Repeated rows and null ids are scored like
    others; other columns of docs are never looked at.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(kept.mapInArrow(_measure, "id long, x binary"), "statistics")
    trees = _learn(rows, labels, id_col, label_col, mod, rest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trees(**trees.value)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.float32).reshape(b.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.score(x))], ["id", "score"])

    scored = rows.mapInArrow(score, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), mod, rest).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 4, rest: int = 2, limit: float = 0.7) -> DataFrame:
    """The rows of docs, as they are, whose score (see score_quality) is at least `limit`. Only labelled documents are measured to fit the trees."""
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = small(labels.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct())
    trees = _learn(kept.join(ids, "id", "left_semi").mapInArrow(_measure, "id long, x binary"), labels, id_col, label_col, mod, rest)

    def run(texts: pd.Series) -> pd.Series:
        powers, own, out = Powers(), Trees(**trees.value), [np.zeros(0)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], ["text"])
        for b in slices(iter([batch]), "text"):
            x = statistics(*flat_bytes(b.column(0)), powers).astype(np.float32).astype(np.float64)
            out.append(own.score(x))
        return pd.Series(np.concatenate(out))

    return docs.where(F.pandas_udf(run, "double")(F.col(text_col).cast("string")) >= limit)
