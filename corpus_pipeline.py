"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.llm import minhash_dedup, packing, quality, suffix_dedup, toxicity
from relspan.llm._store import materialize

#: Bytes from which a passage is cut where it occurs again: some 50 words of the shortest prose.
PASSAGE = 256


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored as good."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    others = minhash_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE bytes and more that occur again; n_chars is that of what is left."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup.remove_repeats(docs, PASSAGE, texts="text", carry=others)
    text = F.col("kept").cast("string")
    columns = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(f"rest.`{c}`") for c in others}
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]
#: No SQL: the classifiers, the suffixes and the tokenizer are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
