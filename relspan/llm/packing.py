"""Cost-balanced packing of documents into sequences of a fixed length.

A document of n tokens costs LINEAR * n + QUADRATIC * n**2 (attention looks at pairs of tokens). What a document has
beyond its whole sequences is a piece. Pieces of a block of documents go, in descending order of cost, to the sequence
of lowest cost so far that still has room; as many sequences are opened as the block's tokens fill. A piece for which
no sequence has room whole is cut over those with most room, so a block wastes less than one sequence.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from relspan.llm._text import slices
from relspan.llm.tokenize import Encoder, read_word_merges, unicode_classes

LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that are packed together; a block's ids are held in memory as 4 bytes each.
BLOCK_TOKENS = 4_000_000
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with the given numbers of tokens.

    Sequences are numbered from 0; offsets in each are gapless. Documents without tokens have no piece.
    """
    out, sequence = [], 0
    rest = []
    for d, n in enumerate(sizes):
        for start in range(0, n - length + 1, length):
            out.append((d, start, length, sequence, 0))
            sequence += 1
        if n % length:
            rest.append((n % length, d))
    rest.sort(key=lambda x: (-cost(x[0]), x[1]))
    total = sum(n for n, _ in rest)
    count = -(-total // length)
    room = [length] * count
    heap = [(0.0, s) for s in range(count)]
    late = []
    for n, d in rest:
        # Sequences too full for this piece may still take a later, smaller one.
        skipped = []
        while heap and room[heap[0][1]] < n:
            skipped.append(heapq.heappop(heap))
        if heap:
            c, s = heapq.heappop(heap)
            out.append((d, sizes[d] - n, n, sequence + s, length - room[s]))
            room[s] -= n
            if room[s]:
                heapq.heappush(heap, (c + cost(n), s))
        else:
            late.append((n, d))
        for x in skipped:
            heapq.heappush(heap, x)
    open_ = sorted((-r, s) for s, r in enumerate(room) if r)
    heapq.heapify(open_)
    for n, d in late:
        start = sizes[d] - n
        while n:
            r, s = heapq.heappop(open_)
            take = min(n, -r)
            out.append((d, start, take, sequence + s, length - room[s]))
            room[s] -= take
            if room[s]:
                heapq.heappush(open_, (-room[s], s))
            start, n = start + take, n - take
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece; every id is in one piece.

    A document's ids are its text's (none if null) and end_id. Documents are packed in blocks of the rows that a task
    reads one after another, so there is no shuffle and any key, source or copy may be as frequent as it likes; a block
    holds block_tokens tokens, one longer document being a block of its own. sequence_id is unique over all tasks.
    Null and repeated ids are carried along; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vars(read_word_merges(tokenizer_path)), unicode_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        library = []
        base = TaskContext.get().partitionId() << 40
        keys, ids, held = [], [], 0

        def special(text: str) -> np.ndarray:
            """Texts that spell a special token are left to the library."""
            if not library:
                from tokenizers import Tokenizer

                library.append(Tokenizer.from_file(tokenizer_path))
            return np.array(library[0].encode(text, add_special_tokens=False).ids, dtype=np.int32)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, keys, ids, held
            sizes = [len(x) for x in ids]
            pieces = pack(sizes, length)
            top = 0
            rows = []
            for d, start, n, s, at in pieces:
                rows.append((keys[d], start, n, zlib.crc32(ids[d][start : start + n].astype("<u4").tobytes()), sizes[d], base + s, at))
                top = max(top, s + 1)
            base += top
            keys, ids, held = [], [], 0
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=key_type), *(pa.array(c, type=pa.int64()) for c in cols[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        key_type = None
        for b in slices(batches, "text"):
            key_type = b.schema.field(0).type
            texts = b.column(1).fill_null("").to_pylist()
            odd = {i: special(t) for i, t in enumerate(texts) if "<|" in t and any(x in t for x in SPECIAL)}
            flat, off = encoder.encode(["" if i in odd else t for i, t in enumerate(texts)])
            for i, key in enumerate(b.column(0).to_pylist()):
                own = np.append(odd[i] if i in odd else flat[off[i] : off[i + 1]], np.int32(end_id))
                if keys and held + len(own) > block_tokens:
                    yield from flush()
                keys.append(key)
                ids.append(own)
                held += len(own)
        if keys:
            yield from flush()

    kept = docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text")
    schema = f"id {kept.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)
