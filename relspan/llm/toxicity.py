"""Toxicity by two class-conditional Kneser-Ney language models of words.

Counts are continuation counts: for each class the number of different training documents that a word occurs in, so a
document that repeats itself counts once. They cover the labelled training documents but those that set the logistic function, by whole 64-bit word hashes in a
grouped table. A class's model takes a discount off each count and gives
what it took to the backoff: the counts that both classes share. The discount grows with the count that chance explains
(the class's part of the shared count, and some of its deviations), so that rare expressions have their probability
from the shared backoff in both models and tell nothing, and only words well over their share do. How many deviations
are taken off, and whether a document's log-likelihoods are normalised by its words or by their root, is chosen by the
training documents that set the logistic function: the score is this function of the two normalised log-likelihoods'
difference. Of the model only the words over their share are kept, since all others have one common ratio; scoring has
them as a broadcast or, if they are many, by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._store import materialize, small
from relspan.llm._text import WORD_BYTE, Powers, flat_bytes, slices, words
from relspan.llm.quality import held_out

#: Words over their share up to which these are broadcast (24 bytes a word).
BROADCAST_WORDS = 1 << 20
#: Words that a task counts before it hands them on.
HELD = 1 << 20
#: Least discount of a count; deviations taken off besides, to choose from; powers of the number of words, likewise.
DISCOUNT, STRICT, POWER = 1.0, (2.0, 3.0, 4.0, 6.0), (1.0, 0.5)
#: Cells of the calibration's histograms either side of 0, and their widths by power.
CELLS, WIDTH = 4000, (0.001, 0.02)


def tokens(data: np.ndarray, off: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and first words."""
    h, _, _, first = words(data, off, WORD_BYTE, powers)
    return h.view(np.int64), first


def _once(data: np.ndarray, off: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts and their different words, how often each occurs, and the texts' numbers of words."""
    w, first = tokens(data, off, powers)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((w, doc))
    doc, w = doc[order], w[order]
    new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])]) if len(w) else np.zeros(0, np.int64)
    return doc[new], w[new], np.diff(np.r_[new, len(w)]), np.diff(first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, ordinary, toxic): in how many texts of each class a word occurs, of rows (text, toxic)."""
    powers, held = Powers(), []

    def merged() -> pa.RecordBatch:
        w, n = (np.concatenate(x) for x in zip(*held, strict=True))
        word, at = np.unique(w, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(word), *(pa.array(np.bincount(at, n[:, c], len(word)).astype(np.int64)) for c in (0, 1))], ["word", "ordinary", "toxic"])

    for b in slices(batches, "text"):
        toxic = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, w, _, _ = _once(*flat_bytes(b.column(0)), powers)
        word, at = np.unique(w, return_inverse=True)
        held.append((word, np.bincount(2 * at + toxic[doc], minlength=2 * len(word)).reshape(-1, 2)))
        if sum(len(x) for x, _ in held) > HELD:
            yield merged()
            held = []
    if held:
        yield merged()


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, n, words, times) of rows (row, text)."""
    powers = Powers()
    for b in slices(batches, "text"):
        doc, w, times, n = _once(*flat_bytes(b.column(1)), powers)
        ends = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (w, times))], ["row", "n", "words", "times"])


def model(counts: DataFrame) -> tuple[DataFrame, list[float]]:
    """Of (word, ordinary, toxic): the words over their share with their log-likelihood ratios (toxic to ordinary, for each
    strictness) less that of all other words, and the latter."""
    t = counts.agg(F.sum("ordinary"), F.sum("toxic"), F.count("*")).first()
    total, seen = [float(t[0] or 0), float(t[1] or 0)], t[2]
    names = [f"r{i}" for i in range(len(STRICT))]
    if not all(total):
        return counts.limit(0).select("word", *[F.lit(0.0).alias(r) for r in names]), [0.0] * len(STRICT)
    both = F.col("ordinary") + F.col("toxic")
    shared = (both + 0.01) / (sum(total) + 0.01 * (seen + 1))  # words never seen share what one hundredth of a count is
    over = []
    for z in STRICT:
        chance = [both * (n / sum(total)) for n in total]
        over.append([F.greatest(F.col(c) - e - F.sqrt(e) * z - DISCOUNT, F.lit(0.0)) for c, e in zip(("ordinary", "toxic"), chance, strict=True)])
    some = materialize(counts.where((over[0][0] > 0) | (over[0][1] > 0)), "over")  # none is over a stricter share only
    taken = some.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for pair in over for x in pair]).first()
    ratios, rest = [], []
    for i, pair in enumerate(over):
        spare = [1 - taken[2 * i + c] / total[c] for c in (0, 1)]
        rest.append(float(np.log(spare[1] / spare[0])))
        ratios.append((F.log((pair[1] / total[1] + shared * spare[1]) / (pair[0] / total[0] + shared * spare[0])) - rest[i]).alias(names[i]))
    return some.select("word", *ratios), rest


def _fields(found: pa.Table, rest: list[float]) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """What Models is made from, of a table (word, r0, r1, ...)."""
    word = found["word"].to_numpy()
    order = np.argsort(word)
    return word[order], [found[f"r{i}"].to_numpy().astype(np.float32)[order] for i in range(len(rest))], rest


class Models:
    """The log-likelihood ratio of words, toxic to ordinary, for each strictness: of those over their share, and of the rest."""

    def __init__(self, word: np.ndarray, ratio: list[np.ndarray], rest: list[float]) -> None:
        """Words in order, and for each strictness their ratios and that of all others."""
        self.word, self.ratio, self.rest = word, ratio, rest

    def compare(self, data: np.ndarray, off: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean ratio a word, for each strictness (columns), and its number of words; 0 without words."""
        w, first = tokens(data, off, powers)
        n = np.diff(first)
        out = np.zeros((len(n), len(STRICT)))
        out[n > 0] = self.rest
        if len(w) and len(self.word):
            at = np.minimum(np.searchsorted(self.word, w), len(self.word) - 1)
            hit = np.flatnonzero(self.word[at] == w)
            doc = np.searchsorted(first, hit, side="right") - 1
            for i, table in enumerate(self.ratio):
                out[:, i] += np.bincount(doc, table[at[hit]].astype(np.float64), len(n)) / np.maximum(n, 1)
        return out, n


def calibrate(x: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset of a logistic function of x, by Newton steps on counts of both classes, and their loss.

    Without both classes the function is the smoothed rate of toxic ones.
    """
    n = toxic + ordinary
    rate = (toxic.sum() + 1) / (n.sum() + 2)
    slope, offset, mean, scale = 0.0, float(np.log(rate / (1 - rate))), 0.0, 1.0
    if toxic.sum() and ordinary.sum():
        mean = (x * n).sum() / n.sum()
        scale = float(np.sqrt((n * (x - mean) ** 2).sum() / n.sum())) or 1.0
        u = (x - mean) / scale
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(slope * u + offset, -30, 30)))
            v = n * p * (1 - p)
            g = np.array([(u * (toxic - n * p)).sum() - 1e-3 * slope, (toxic - n * p).sum()])
            h = np.array([[(v * u * u).sum() + 1e-3, (v * u).sum()], [(v * u).sum(), v.sum() + 1e-6]])
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            slope, offset = slope + step[0], offset + step[1]
            if np.abs(step).max() < 1e-8:
                break
    slope, offset = slope / scale, offset - slope * mean / scale
    p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
    return slope, offset, float(-(toxic * np.log(p) + ordinary * np.log(1 - p)).sum())


class Toxicity:
    """Models and logistic function learned from labelled documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, mod: int, rest: int, tune: int) -> None:
        self.names = (id_col, text_col)
        self.ratios = [f"r{i}" for i in range(len(STRICT))]
        kept = self._kept(docs)
        self.training = ~held_out(F.col("id"), mod, rest)
        self.tuning = self.training & held_out(F.col("id"), mod, tune)
        own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.round(F.avg("y")).cast("int").alias("y"))
        self.labels = small(materialize(own, "labels"))
        taught = kept.where(self.training & ~self.tuning).join(self.labels, "id").select("text", F.col("y").alias("toxic"))
        counts = taught.mapInArrow(_count, "word long, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
        found, self.rest = model(materialize(counts, "counts"))
        self.found = materialize(found, "model")
        self.models = None
        if self.found.count() <= BROADCAST_WORDS:
            self.models = docs.sparkSession.sparkContext.broadcast(_fields(self.found.toArrow(), self.rest))

    def _kept(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.names[0]).cast("long").alias("id"), F.col(self.names[1]).cast("string").alias("text"))

    def compare(self, docs: DataFrame) -> DataFrame:
        """(id, n, ratios) of each row."""
        models, ratios = self.models, self.ratios
        if models is None:
            return self._joined(docs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers, own = Powers(), Models(*models.value)
            for b in slices(batches, "text"):
                ratio, n = own.compare(*flat_bytes(b.column(1)), powers)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *(pa.array(c) for c in ratio.T)], ["id", "n", *ratios])

        return docs.mapInArrow(run, f"id long, n long, {', '.join(f'{r} double' for r in ratios)}")

    def _joined(self, docs: DataFrame) -> DataFrame:
        """compare() by a join of the texts' words with the model."""
        keyed = materialize(docs.select("id", "text", F.monotonically_increasing_id().alias("row")), "keyed")
        words = keyed.select("row", "text").mapInArrow(_occurring, "row long, n long, words array<long>, times array<long>")
        hits = words.select("row", "n", F.explode_outer(F.arrays_zip("words", "times")).alias("x")).select("row", "n", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
        sums = hits.join(self.found, "word", "left").groupBy("row").agg(F.first("n").alias("n"), *[F.sum(F.col(r) * F.col("times")).alias(r) for r in self.ratios])
        means = [F.when(F.col("n") > 0, F.coalesce(F.col(r), F.lit(0.0)) / F.col("n") + x).otherwise(0.0).alias(r) for r, x in zip(self.ratios, self.rest, strict=True)]
        return keyed.select("id", "row").join(sums, "row").select("id", "n", *means)

    def tune(self, rows: DataFrame) -> None:
        """Choose strictness and power, and fit the logistic function, on the tuning rows among `rows`."""
        ways = [(i, j) for i in range(len(STRICT)) for j in range(len(POWER))]
        cells = F.array(*[F.greatest(F.least(F.round(self._normal(i, j) / WIDTH[j]), F.lit(CELLS)), F.lit(-CELLS)).cast("int") for i, j in ways])
        tuned = rows.where(self.tuning).join(self.labels, "id").select("y", F.posexplode(cells).alias("way", "cell"))
        told = tuned.groupBy("way", "cell").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).collect()  # bounded by the cells
        found = []
        for w, (i, j) in enumerate(ways):
            mine = [r for r in told if r["way"] == w]
            toxic, n = (np.array([r[c] for r in mine], dtype=np.float64) for c in ("toxic", "n"))
            slope, offset, loss = calibrate(np.array([r["cell"] * WIDTH[j] for r in mine], dtype=np.float64), toxic, n - toxic)
            found.append((loss, w, slope, offset))
        _, w, self.slope, self.offset = min(found)
        self.way = ways[w]

    def _normal(self, i: int, j: int):
        """Normalised by n ** power: the mean times n ** (1 - power)."""
        return F.col(self.ratios[i]) * F.pow(F.col("n"), 1 - POWER[j])

    def score(self):
        """The score as a column of a table of ratios."""
        return 1 / (1 + F.exp(-(self._normal(*self.way) * float(self.slope) + float(self.offset))))

    def score_text(self, text):
        """The score as a column of a text column, computed on executors."""
        models, (i, j), slope, offset = self.models, self.way, float(self.slope), float(self.offset)

        def run(texts: pd.Series) -> pd.Series:
            powers, own, out = Powers(), Models(*models.value), [np.zeros(0)]
            batch = pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], ["text"])
            for b in slices(iter([batch]), "text"):
                ratio, n = own.compare(*flat_bytes(b.column(0)), powers)
                out.append(1 / (1 + np.exp(-(ratio[:, i] * n ** (1 - POWER[j]) * slope + offset))))
            return pd.Series(np.concatenate(out))

        return F.pandas_udf(run, "double")(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 5, rest: int = 0, tune: int = 1, limit: float = 0.5) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs; score is the chance of label 1, predicted whether it reaches `limit`.

    Labels are learned from rows whose crc32(id) % mod is not rest: those with remainder `tune` set the logistic
    function, all others are counted by the models. Null and empty texts, and texts without words, have a ratio of 0.
    Null labels and labels without a document are not learned from; several labels of one id count by their mean,
    rounded. Without labels of both classes the score is the smoothed rate of label 1. Repeated rows and null ids are
    scored like others; other columns of docs are never looked at.
    """
    learned = Toxicity(docs, labels, id_col, text_col, label_col, mod, rest, tune)
    rows = materialize(learned.compare(learned._kept(docs)), "ratios")
    learned.tune(rows)
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id"), mod, rest).alias("held_out"), learned.score().alias("score")).withColumn("predicted", (F.col("score") >= limit).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 5, rest: int = 0, tune: int = 1, limit: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, whose score (see score_toxicity) is below `limit`."""
    learned = Toxicity(docs, labels, id_col, text_col, label_col, mod, rest, tune)
    learned.tune(learned.compare(learned._kept(docs).where(learned.tuning).join(learned.labels.select("id"), "id", "left_semi")))
    if learned.models is not None:
        return docs.where(learned.score_text(F.col(text_col).cast("string")) < limit)
    keyed = materialize(docs.select(F.struct("*").alias("rest"), F.monotonically_increasing_id().alias("id")), "docs")
    clean = learned.compare(keyed.select("id", F.col("rest")[text_col].cast("string").alias("text"))).where(learned.score() < limit)
    return keyed.join(clean.select("id"), "id").select("rest.*")
