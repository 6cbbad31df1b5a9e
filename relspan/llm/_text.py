"""Vectorised text primitives: Arrow strings as one byte array, word spans, and rolling 64-bit hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * BASE)

#: Words are split by space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters, digits and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTE[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings (null: empty) end to end, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def give_back() -> None:
    """Return freed memory to the system: a worker is used again, and its next task may be of another kind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 512 << 10, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of at most `rows` rows with about `budget` bytes of text; one longer text is a run of its own."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = flat_bytes(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(off, off[lo] + budget, side="right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


#: A second modulus, 2**31 - 1: strings that collide modulo 2**64 for any base, such as Thue-Morse ones, differ here.
PRIME = 2**31 - 1
BASE31 = 0x2545F491
CODE31 = (BYTE_CODE >> U64(34)) + U64(1)


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number (of 32 bits, for 62) that is the same modulo PRIME."""
    return (x & U64(PRIME)) + (x >> U64(31))


def _residues(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n."""
    out = np.ones(1, dtype=U64)
    while len(out) < n:
        out = np.concatenate([out, out * U64(pow(base, len(out), PRIME)) % U64(PRIME)])
    return out[:n]


class Powers:
    """Powers of both bases and of their inverses, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = self.up31 = self.down31 = np.ones(1, dtype=U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, b, dtype=U64))]) for b in (BASE, INVERSE))
            self.up31, self.down31 = (_residues(b, n).astype(np.uint32) for b in (BASE31, pow(BASE31, -1, PRIME)))


class Rolling:
    """Hashes of any substrings of one byte array in constant time each: of their polynomials modulo 2**64 and PRIME."""

    def __init__(self, data: np.ndarray, powers: Powers) -> None:
        n = len(data)
        powers.grow(n + 1)
        self.down, self.down31 = powers.down, powers.down31
        self.sums, self.sums31 = np.zeros(n + 1, dtype=U64), np.zeros(n + 1, dtype=U64)
        np.cumsum(BYTE_CODE[data] * powers.up[:n], out=self.sums[1:])
        np.cumsum(_fold(CODE31[data] * powers.up31[:n]), out=self.sums31[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end]; equal bytes hash equally wherever they stand."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        r = (self.sums31[end] - self.sums31[start]) % U64(PRIME) * self.down31[start] % U64(PRIME)
        return mix((h ^ mix(r)) + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def spans(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that stay within their text: starts, ends, and first run of each text (n + 1 entries)."""
    inside = member[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = off[:-1][off[:-1] < off[1:]]
    before[first] = False
    last = off[1:][off[:-1] < off[1:]] - 1
    after[last] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased), their starts and ends, and the first word of each text."""
    starts, ends, first = spans(data, off, member)
    return Rolling(LOWER[data], powers)(starts, ends), starts, ends, first
