"""Byte-pair tokenising on numpy arrays: pre-tokens of whole batches, merged in length-bucketed padded matrices.

Texts become code points; a table of Unicode classes and run boundaries give the pre-tokens without a regular
expression. Distinct pre-tokens of a batch (found by a hash, told apart by their bytes) are put in padded matrices by
length; in each round every row merges its leftmost pair of least rank, looked up in a hash table, and finished rows
leave the matrix. A matrix needs as many rounds as its rows have merges, each over whole rows, so a pre-token of very
many bytes would take time by the square of its length: beyond Encoder.longest bytes the same merges are taken from a
heap of pairs by rank and place instead.
"""

from __future__ import annotations

import base64
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from relspan.llm._text import Powers, Rolling

U64 = np.uint64
NONE = np.int32(2**31 - 1)
#: Bytes of the longest pre-tokens in matrices; the ids are the same whatever it is.
LONG = 1024
#: Cells of one matrix.
CELLS = 1 << 18

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def unicode_classes() -> np.ndarray:
    r"""For each code point: white space (\s), letter (\p{L}), number (\p{N}) or other."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


@dataclass
class Vocabulary:
    """Symbols by byte, merges in a hash table, and what each id stands for."""

    first: np.ndarray  # id of each single byte
    final: np.ndarray  # id of each byte at a word's end
    slots: np.ndarray  # left id << 32 | right id, or all ones
    ranks: np.ndarray
    merged: np.ndarray
    shift: int
    probes: int
    decoded: list[bytes]
    whole: dict[bytes, int]  # pre-tokens that are one token whatever the merges say
    joins_space: bool  # a space belongs to the word after it; else white space is dropped and numbers are single


def _table(pairs: list[tuple[int, int]], ranks: list[int], merged: list[int]) -> tuple:
    bits = max(4, (4 * len(pairs)).bit_length())
    size, shift = 1 << bits, 64 - bits
    slots, r, m = np.full(size, 2**64 - 1, dtype=U64), np.full(size, NONE, dtype=np.int32), np.zeros(size, dtype=np.int32)
    probes = 1
    for (a, b), rank, out in zip(pairs, ranks, merged, strict=True):
        key = a << 32 | b
        at = (key * 0x9E3779B97F4A7C15 & 2**64 - 1) >> shift
        n = 1
        while slots[at] != 2**64 - 1 and slots[at] != key:
            at, n = (at + 1) % size, n + 1
        if slots[at] == key:
            continue
        slots[at], r[at], m[at] = key, rank, out
        probes = max(probes, n)
    return slots, r, m, shift, probes


def read_ranks(path: str) -> Vocabulary:
    """A file of ranks: base64 of a token's bytes, and its id, which is also its rank."""
    with open(path, "rb") as f:
        whole = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pairs, ranks, merged = [], [], []
    for token, rank in whole.items():
        for k in range(1, len(token)):
            a, b = whole.get(token[:k]), whole.get(token[k:])
            if a is not None and b is not None:
                pairs.append((a, b))
                ranks.append(rank)
                merged.append(rank)
    first = np.array([whole.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
    decoded = [b""] * (max(whole.values()) + 1)
    for token, i in whole.items():
        decoded[i] = token
    return Vocabulary(first, first, *_table(pairs, ranks, merged), decoded, whole, True)


def printable_bytes() -> list[str]:
    """The character that stands for each byte in the token strings of a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_word_merges(path: str) -> Vocabulary:
    """A tokenizer file with a byte-level BPE model whose words end in "</w>", lower case, white space dropped."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, chars = model["vocab"], printable_bytes()
    pairs, ranks, merged = [], [], []
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append((ids[a], ids[b]))
        ranks.append(rank)
        merged.append(ids[a + b])
    back = {c: b for b, c in enumerate(chars)}
    decoded = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        end = token.endswith("</w>")
        body = token[:-4] if end else token
        decoded[i] = bytes(back[c] for c in body if c in back) + (b" " if end else b"")
    return Vocabulary(np.array([ids[c] for c in chars], dtype=np.int32), np.array([ids[c + "</w>"] for c in chars], dtype=np.int32), *_table(pairs, ranks, merged), decoded, {}, False)


def look_up(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Slot of each pair of ids in the hash table, or -1."""
    key = left.astype(U64) << U64(32) | right.astype(U64)
    at = ((key * U64(0x9E3779B97F4A7C15)) >> U64(v.shift)).astype(np.int64)
    mask = len(v.slots) - 1
    there = v.slots[at]
    found = np.where(there == key, at, -1)
    open_ = np.flatnonzero((there != key) & (there != U64(2**64 - 1)))
    for step in range(1, v.probes):
        if not len(open_):
            break
        here = (at[open_] + step) & mask
        hit = v.slots[here] == key[open_]
        found[open_[hit]] = here[hit]
        open_ = open_[~hit & (v.slots[here] != U64(2**64 - 1))]
    return found


def merge_matrix(v: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of a padded matrix of symbols to its end: the matrix of ids and the rows' lengths."""
    n, width = ids.shape
    lengths = lengths.copy()
    if width < 2:
        return ids, lengths
    out = ids.copy()
    live = np.arange(n)
    cols = np.arange(width)
    work = ids.copy()
    rank = np.full((n, width), NONE, dtype=np.int32)
    r, c = np.nonzero(cols[None, :-1] + 1 < lengths[:, None])
    found = look_up(v, work[r, c], work[r, c + 1])
    rank[r, c] = np.where(found >= 0, v.ranks[found], NONE)
    while len(live):
        at = rank.argmin(axis=1)
        rows = np.arange(len(live))
        done = rank[rows, at] == NONE
        if done.any():
            out[live[done], : work.shape[1]] = work[done]
            go = ~done
            live, at = live[go], at[go]
            if not len(live):
                break
            rows = np.arange(len(live))
            most = int(lengths[live].max())
            work, rank, cols = work[go, :most], rank[go, :most], cols[:most]
        new = v.merged[look_up(v, work[rows, at], work[rows, at + 1])]
        # Close the gap to the right of the merged pair.
        gap = cols[None, :-1] > at[:, None]
        np.copyto(work[:, :-1], work[:, 1:].copy(), where=gap)
        np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=gap)
        work[rows, at] = new
        rank[:, -1] = NONE
        lengths[live] -= 1
        size = lengths[live]
        before, after = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < size)
        rank[rows, at] = NONE
        p = np.concatenate([at[before] - 1, at[after]])
        r = np.concatenate([before, after])
        found = look_up(v, work[r, p], work[r, p + 1])
        rank[r, p] = np.where(found >= 0, v.ranks[found], NONE)
    return out, lengths


def _finder(v: Vocabulary) -> Callable[[int, int], int]:
    """look_up for a pair at a time."""
    slot, mask, empty = v.slots.item, len(v.slots) - 1, 2**64 - 1

    def find(left: int, right: int) -> int:
        key = left << 32 | right
        at = (key * 0x9E3779B97F4A7C15 & empty) >> v.shift
        while (there := slot(at)) != key:
            if there == empty:
                return -1
            at = at + 1 & mask
        return at

    return find


def merge_long(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The same merges for one long pre-token, by a heap of (rank, place) over a linked list, in n log n steps."""
    n, find, rank_of = len(ids), _finder(v), v.ranks.item
    val, nxt, prv = array("q", ids.tolist()), array("q", [*range(1, n), -1]), array("q", range(-1, n - 1))
    at = look_up(v, ids[:-1], ids[1:])
    some = np.flatnonzero(at >= 0)
    heap = ((v.ranks[at[some]].astype(np.int64) << 32) | some).tolist()
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        j = nxt[i]
        if val[i] < 0 or j < 0:
            continue
        k = find(val[i], val[j])
        if k < 0 or rank_of(k) != top >> 32:  # the pair has changed since
            continue
        val[i], val[j] = v.merged.item(k), -1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        for left, right in ((prv[i], i), (i, nxt[i])):
            if left >= 0 and right >= 0 and (k := find(val[left], val[right])) >= 0:
                heapq.heappush(heap, rank_of(k) << 32 | left)
    out = np.frombuffer(val, dtype=np.int64)
    return out[out >= 0].astype(np.int32)


def pre_tokens(codes: np.ndarray, first: np.ndarray, classes: np.ndarray, joins_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of the pre-tokens of texts laid end to end; `first` are the texts' offsets (n + 1)."""
    kind = classes[codes]
    n = len(codes)
    new = np.ones(n, dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    opens = first[:-1][first[:-1] < first[1:]]
    new[opens] = True
    if not joins_space:
        new |= kind == NUMBER
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    k = kind[start]
    text_start = np.zeros(n, dtype=bool)
    text_start[opens] = True
    if joins_space:
        # The last character of a run of white space ahead of a word: a space joins the word, another stands alone.
        stop = np.zeros(n + 1, dtype=bool)
        stop[first[1:]] = True
        led = (k == SPACE) & ~stop[end]
        spare = codes[end - 1] == 0x20
        joined = np.flatnonzero(led & spare)
        alone = np.flatnonzero(led & ~spare & (end - start > 1))
        begin = start.copy()
        begin[joined + 1] -= 1  # the word takes the space
        end = end.copy()
        end[joined] -= 1
        extra_s, extra_e = end[alone] - 1, end[alone].copy()
        end[alone] -= 1
        has_space = np.zeros(len(start), dtype=bool)
        has_space[joined + 1] = True
    else:
        begin, has_space = start, np.zeros(len(start), dtype=bool)
        extra_s = extra_e = np.zeros(0, dtype=np.int64)
    # An apostrophe alone, ahead of letters that start with s, t, m, d, re, ve or ll, takes these along.
    quote = np.flatnonzero((k[:-1] == OTHER) & (end[:-1] - start[:-1] == 1) & (codes[start[:-1]] == 0x27) & ~has_space[:-1] & (k[1:] == LETTER) & ~text_start[start[1:]])
    if len(quote):
        word = quote + 1
        a = codes[start[word]]
        b = np.where(end[word] - start[word] > 1, codes[np.minimum(start[word] + 1, n - 1)], 0)
        take = np.where(np.isin(a, [0x73, 0x74, 0x6D, 0x64]), 1, 0)
        take = np.where(((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C), 2, take)
        end = end.copy()
        begin = begin.copy()
        end[quote] += take
        begin[word] = np.maximum(begin[word], start[word] + take)
    ok = end > begin
    if not joins_space:
        ok &= k != SPACE
    s, e = np.concatenate([begin[ok], extra_s]), np.concatenate([end[ok], extra_e])
    if len(extra_s):
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
    return s, e


def normalize(text: str) -> str:
    """NFC, then each character's own lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            return "".join(c.lower() for c in text)
    return text.lower()


def same_bytes(data: np.ndarray, s: np.ndarray, t: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[s : s + size] is data[t : t + size], for many spans."""
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(s)), size)
    at = np.arange(ends[-1] if len(ends) else 0) + (s - (ends - size))[owner]
    out = np.ones(len(s), dtype=bool)
    out[owner[data[at] != data[at + (t - s)[owner]]]] = False
    return out


class Encoder:
    """Encodes batches of texts under one vocabulary, given by its fields, which any worker can unpickle."""

    def __init__(self, vocabulary: dict, classes: np.ndarray, longest: int = LONG) -> None:
        self.v, self.classes, self.powers, self.longest = Vocabulary(**vocabulary), classes, Powers(), longest

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the texts' offsets (n + 1)."""
        v = self.v
        if not v.joins_space:
            texts = [normalize(t) for t in texts]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first = np.concatenate([[0], np.cumsum(lengths)])
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        data = np.frombuffer(whole.encode(), dtype=np.uint8)
        s, e = pre_tokens(codes, first, self.classes, v.joins_space)
        token_at = np.searchsorted(s, first)
        if len(data) != len(codes):
            place = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)])
            s, e = place[s], place[e]
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        index, inverse = self._alike(data, s, e)
        flat, start, count = self._distinct(data, s[index], e[index])
        n = count[inverse]
        ends = np.cumsum(n)
        ids = flat[np.repeat(start[inverse] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[token_at]

    def _alike(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One span of each distinct content, and which of these each span is like; hashes find them, bytes decide."""
        _, index, inverse = np.unique(self._hashes(data, s, e), return_index=True, return_inverse=True)
        size, like = e - s, index[inverse]
        same = size == size[like]
        same[same] = same_bytes(data, s[same], s[like[same]], size[same])
        if same.all():
            return index, inverse
        others: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(~same).tolist():  # collisions: as good as none
            own = data[s[i] : e[i]].tobytes()
            if own not in others:
                others[own] = len(index) + len(more)
                more.append(i)
            inverse[i] = others[own]
        return np.concatenate([index, more]), inverse

    def _hashes(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return Rolling(data, self.powers)(s, e)

    def _distinct(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the given spans end to end, with the start and count of each."""
        v, size = self.v, e - s
        count, start = np.zeros(len(s), dtype=np.int64), np.zeros(len(s), dtype=np.int64)
        parts, total = [], 0
        rest = np.ones(len(s), dtype=bool)
        if v.whole:
            raw = data.tobytes()
            got = np.array([v.whole.get(raw[a:b], -1) for a, b in zip(s.tolist(), e.tolist(), strict=True)], dtype=np.int32)
            rest = got < 0
            hit = np.flatnonzero(~rest)
            start[hit], count[hit], total = np.arange(len(hit)), 1, len(hit)
            parts.append(got[hit])
        for i in np.flatnonzero(rest & (size > self.longest)).tolist():
            ids = v.first[data[s[i] : e[i]]]
            ids[-1] = v.final[data[e[i] - 1]]
            ids = merge_long(v, ids)
            start[i], count[i], total = total, len(ids), total + len(ids)
            parts.append(ids)
        todo = np.flatnonzero(rest & (size <= self.longest))
        todo = todo[np.argsort(size[todo], kind="stable")]
        at = 0
        while at < len(todo):
            # Rows of about one length: up to an eighth longer than the shortest.
            low = int(size[todo[at]])
            high = low + low // 8
            stop = min(int(np.searchsorted(size[todo], high, side="right")), at + max(1, CELLS // high))
            rows = todo[at:stop]
            width = int(size[rows].max())
            cols = np.arange(width)
            inside = cols[None, :] < size[rows][:, None]
            ids = np.where(inside, v.first[data[np.minimum(s[rows][:, None] + cols, len(data) - 1)]], 0).astype(np.int32)
            ids[np.arange(len(rows)), size[rows] - 1] = v.final[data[e[rows] - 1]]
            ids, n = merge_matrix(v, ids, size[rows])
            parts.append(ids[cols[None, :] < n[:, None]])
            count[rows] = n
            start[rows] = total + np.concatenate([[0], np.cumsum(n)[:-1]])
            total += int(n.sum())
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), start, count
