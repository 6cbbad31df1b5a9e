"""Byte-level BPE encoding and decoding of whole texts (the matrices are in tokenize.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relspan.llm._text import slices
from relspan.llm.tokenize import Encoder, Vocabulary, read_ranks, unicode_classes


def decode(decoded: list[bytes], ids: list[int]) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join([decoded[i] for i in ids])


def _shared(df: DataFrame, v: Vocabulary):
    """The vocabulary's fields and the Unicode classes on all executors: a few MB, fixed by the vocabulary file."""
    return df.sparkSession.sparkContext.broadcast((vars(v), unicode_classes()))


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row: the ids of its text, without special tokens. A null text has no ids.

    Rows are kept one to one whatever their ids (null and repeated ones too); other columns are ignored. No shuffle:
    each task encodes its own rows, a few MB of text at a time.
    """
    shared = _shared(docs, read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for b in slices(batches, "text"):
            ids, off = encoder.encode(b.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))], ["id", "ids"])

    kept = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, data binary) for every row of ids; null ids are empty. Unknown ids are an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path).decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [decode(shared.value, x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, type=pa.binary())], ["id", "data"])

    kept = encoded.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids")
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, data binary").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode_documents and decode_documents in one pass, as digests.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the bytes that the ids decode to; both are
    lower-case hex, of the empty string for null and empty texts.
    """
    shared = _shared(docs, read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        decoded = encoder.v.decoded
        names = [str(i) for i in range(len(decoded))]
        for b in slices(batches, "text"):
            ids, off = encoder.encode(b.column(1).fill_null("").to_pylist())
            ids, off = ids.tolist(), off.tolist()
            n, a, d = [], [], []
            for lo, hi in zip(off, off[1:], strict=False):
                own = ids[lo:hi]
                n.append(hi - lo)
                a.append(hashlib.sha256(",".join([names[i] for i in own]).encode()).hexdigest())
                d.append(hashlib.sha256(decode(decoded, own)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64()), pa.array(a), pa.array(d)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
