"""The training-data operators against brute force, libraries and planted cases, with nulls, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from relspan.llm import byte_bpe, embedding_dedup, hamming_topk, kd_shard, minhash_dedup, packing, quality, suffix_dedup, toxicity, url_filter
from relspan.llm.catalogue import RULES

TEXTS = "doc_id long, text string, lang string, source string, n_chars long, id string, k string"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", None) for i, t in rows], TEXTS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_url_filter(spark):
    urls = ["https://a.Example.org/es/1", "http://example.org/en/12", "http://notexample.org/es/", "https://x.com/fr/?q", "https://com/de/", "http://a.org", None, "no scheme", "", "ftp://b.net/es/#x", "https://x.com/fr/?q"]
    pages = spark.createDataFrame([(i if i != 4 else None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect())
    want = Counter()
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (m[1].lower(), m[2]) if m else ("", "")
        fit = max(((len(a + b), a + b, v) for a, b, v in RULES if (h == a or h.endswith("." + a)) and p.startswith(b)), default=(0, None, "allow"))
        want[(i if i != 4 else None, h, p, *fit[1:])] += 1
    assert got == want
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


@pytest.mark.parametrize("bucket", [16_000, 4, 1])
def test_suffix_dedup(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "COMMON", min(bucket, 1000))
    rng = random.Random(1)
    passage = prose(rng, 160)
    rows = [(i, prose(rng, rng.randrange(80)) + passage[rng.randrange(90) : rng.randrange(480, 640)] + prose(rng, rng.randrange(80))) for i in range(25)]
    rows += [(90, None), (91, ""), (92, "é" * 300), (93, passage[:399]), (94, passage[:400]), (None, passage[50:500]), (95, rows[0][1]), (95, rows[0][1])]
    counts, want = Counter(), Counter()
    for _, t in rows:
        b = (t or "").encode()
        counts.update(b[i : i + 400] for i in range(len(b) - 399))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - 399):
            if counts[b[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[(i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    out = suffix_dedup.remove_repeats(table(spark, rows), carry=("source",)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want
    assert all(r.rest.source == "s" for r in out)
    assert suffix_dedup.remove_repeats(table(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [4096, 3])
def test_minhash(spark, monkeypatch, bucket):
    monkeypatch.setattr(minhash_dedup, "SMALL_BUCKET", bucket)
    rng = random.Random(2)
    rows = []
    for g in range(12):
        words = prose(rng, rng.randrange(3, 120)).split()
        for _ in range(rng.randrange(1, 7)):
            w = list(words)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(200, None), (201, "  \n"), (202, "A b"), (203, "a  B"), (204, "é B"), (205, rows[0][1]), (205, rows[0][1]), (None, rows[0][1])]
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(table(spark, rows)).collect()}
    want = {(i, len(sets[i]), find(i), find(i) == i) for i in ids}
    assert {r for r in got if r[0] is not None} == want
    assert minhash_dedup.near_duplicates(table(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("bucket, most", [(3, 16_384), (20, 16_384), (2, 1), (4096, 16_384)])
def test_minhash_pairs_of_one_common_band(spark, monkeypatch, bucket, most):
    """Pairs that share one bucket only are found there, however large it is."""
    import pyarrow as pa

    monkeypatch.setattr(minhash_dedup, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(minhash_dedup, "MANY", 5, raising=False)
    monkeypatch.setattr(minhash_dedup, "BLOCK_MOST", most, raising=False)
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(20)]
    texts += [t + " one more" for t in texts[5:]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc", "text"])
    rows = pa.Table.from_batches(minhash_dedup._sketch(iter([batch]), minhash_dedup.BANDS, minhash_dedup.ROWS)).to_pylist()
    reps = [(r["doc"], r["n"], [7 if b == 30 else 100 * b + r["doc"] for b in range(minhash_dedup.BANDS)], r["brief"]) for r in rows]
    reps = spark.createDataFrame(reps, "rep long, n long, bands array<long>, brief binary")
    labels = minhash_dedup._Buckets(reps, spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), 75).run()
    assert {(r.node, r.component) for r in labels.collect()} == {(i, j) for j in range(5, 20) for i in (j, j + 15)}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        center = rng.normal(size=16)
        rows += [(len(rows) + k, [float(v) for v in center + rng.normal(size=16) * 0.08]) for k in range(8)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, links int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    ids = [i for i, v in rows if i is not None and i < 900 or i == 903]
    m = np.array([np.float32(v) for i, v in rows if i in ids], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    links = (m @ m.T >= 0.95).sum(axis=1) - 1
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.9 * links.sum() and all(got[i].n_links <= n for i, n in zip(ids, links, strict=True))
    assert got[903].component_id == 0 and got[0].kept and not got[903].kept
    assert [(got[i].n_links, got[i].component_id) for i in (900, 901, 902)] == [(0, 900), (0, 901), (0, 902)]
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("count, block", [(63, 2000), (282, 200), (999, 2000)])
def test_embeddings_of_a_crowded_group(spark, monkeypatch, count, block):
    """A third of the vectors in one group whose members mostly link with each other, at several pivot counts."""
    monkeypatch.setattr(embedding_dedup, "PIVOTS_LEAST", count)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(7)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    m = unit(rng.normal(size=(3000, 64)))
    m[::3] = unit(m[0] + 0.21 * unit(rng.normal(size=(1000, 64))))
    m[1:1500:3] = unit(m[1501::3] + 0.2 * unit(rng.normal(size=(500, 64))))
    cosine = m @ m.T
    links = (cosine >= 0.95).sum(axis=1) - 1
    assert links[::3].mean() > 500 and abs(cosine - 0.95).min() > 1e-12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    found = np.array([got[i].n_links for i in range(len(m))])
    assert (found <= links).all() and found[::3].sum() >= 0.9 * links[::3].sum() and found.sum() >= 0.9 * links.sum()
    assert {got[i].component_id for i in np.flatnonzero(links) if i % 3 == 0} == {0}


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(1500)] + [(5000 + i, "same text " * 20) for i in range(700)] + [(None, None), (7, ""), (7, "")]
    out = kd_shard.shard_documents(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    total = Counter()
    for r in out:
        total[r["shard"]] += r["size"]
    assert sorted(total) == list(range(24)) and max(total.values()) <= 1.1 * sum(total.values()) / 24
    for s in range(24):
        assert sorted(r.slot for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert kd_shard.shard_documents(table(spark, []).limit(0)).collect() == []


def test_shards_keep_equal_texts(spark):
    """A group of equal texts is in one shard if it has no more than a part of a shard's bytes."""
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randrange(20, 80))) for i in range(3000)]
    rows += [(10_000 + 100 * g + k, f"group {g} " + "of equal texts " * 10) for g in range(40) for k in range(rng.randrange(2, 30))]
    for whole in (0.2, float("inf")):
        out = kd_shard.shard_documents(table(spark, rows), whole=whole).collect()
        share = sum(r["size"] for r in out) / 24
        groups = {}
        for r in out:
            groups.setdefault(r.text_crc32, []).append((r.shard, r["size"]))
        kept = [g for g in groups.values() if sum(n for _, n in g) <= whole * share]
        assert len(kept) > 3000 and all(len({s for s, _ in g}) == 1 for g in kept)


def test_hamming(spark):
    rng = random.Random(5)
    codes = [(i, rng.getrandbits(63) if i % 3 else 7 << (i % 5)) for i in range(400)] + [(None, 5), (999, None), (3, 1)]
    df = spark.createDataFrame(codes, "vec_id long, code long")
    got = {}
    for r in hamming_topk.search(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.neighbor_id, r.distance))
    real = [(i, c) for i, c in codes if i is not None and c is not None]
    for q, c in real:
        if q % 50 == 0:
            best = {}
            for i, x in real:
                if i != q:
                    best[i] = min(best.get(i, 99), (x ^ c).bit_count())
            want = [(n + 1, i, d) for n, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:5])]
            assert sorted(got[q]) == want


def test_hamming_of_many_codes(spark, monkeypatch):
    """The segments for many codes are no wider than all masks of a radius allow; the search ends at its radius."""
    count = hamming_topk.segment_count
    assert all(64 // count(n) <= 16 and 64 % count(n) == 0 for n in (0, 1, 80_000, 2_640_000, 4_700_000, 10**9, 10**12))
    monkeypatch.setattr(hamming_topk, "segment_count", lambda n: count(4_700_000))
    codes = [(i, i * 0x0123456789ABCDEF % 2**63) for i in range(60)]
    df = spark.createDataFrame(codes, "vec_id long, code long")
    got = [(r["rank"], r.neighbor_id, r.distance) for r in hamming_topk.search(df, df.where("vec_id = 7"), 5).collect()]
    near = sorted(((c ^ codes[7][1]).bit_count(), i) for i, c in codes if i != 7)[:5]
    assert sorted(got) == [(n + 1, i, d) for n, (d, i) in enumerate(near)]


def test_hamming_of_ids_with_many_codes(spark):
    """Codes of the query's own id, or of one neighbour's, fill each list that holds the last neighbour."""
    crowd = [0, 7, 7 << 4, *(7 | 16 << b for b in range(4)), *(7 << 4 | 1 << b for b in range(4))]
    for other in (1, 2):
        df = spark.createDataFrame([(1, 0), *((other, c) for c in crowd), (9, 7 | 7 << 4)], "vec_id long, code long")
        got = [(r["rank"], r.neighbor_id, r.distance) for r in hamming_topk.search(df, df.where("vec_id = 1 and code = 0"), 3).collect()]
        assert sorted(got) == ([(1, 9, 6)] if other == 1 else [(1, 2, 0), (2, 9, 6)])


ODD = ["I'll  can't\n\n x", "''s 's'S", "a b c  ", "١٢3½ é é", "漢字🙂🙂", "", None, "x" * 700, "<|endoftext|> a", "\t \x85\x1c  don't", "ΑΣ İ"]


def test_byte_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, list(enumerate(ODD)))
    got = {r.doc_id: r.ids for r in byte_bpe.encode_documents(docs, path).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path), path).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in back} == {i: t or "" for i, t in enumerate(ODD)}


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(6)
    rows = [*enumerate(ODD), *((100 + i, prose(rng, rng.randrange(1, 1500))) for i in range(60))]
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    out = packing.pack_documents(table(spark, rows), path).collect()
    pieces, places = {}, {}
    for r in out:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in pieces.items():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1]) and sum(n for _, n in parts) == len(ids[i])
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1]) and sum(n for _, n in parts) <= 2048
    assert len(pieces) == len(rows) and len(places) * 2048 <= sum(map(len, ids.values())) + 4 * 2048


@pytest.mark.parametrize("score, label, good", [(quality.score_quality, "quality", 1), (toxicity.score_toxicity, "toxic", 0)])
def test_classifiers(spark, score, label, good):
    """Held-out accuracy, and how many of the documents that ought to stay do."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = score(docs, labels).join(labels, "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("a"), F.avg(F.when(F.col(label) == good, (F.col("predicted") == good).cast("int"))).alias("clean")).first()
    assert right.a > 0.97 and right.clean > 0.98
    odd = score(table(spark, [(1, None), (1, ""), (None, "a b")]), labels.limit(0)).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)
    assert score(table(spark, []), labels).collect() == []


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_toxicity_of_a_large_vocabulary(spark, monkeypatch, broadcast):
    """A toxic word tells in its own right, however many other words there are; few or many words over their share."""
    monkeypatch.setattr(toxicity, "BROADCAST_WORDS", broadcast, raising=False)
    rng = random.Random(9)
    rows = [(i, " ".join(f"v{rng.randrange(10**9)}" for _ in range(1000)) + (f" bad{i % 75}" if i % 10 == 0 else "")) for i in range(1500)]
    docs, labels = table(spark, rows), spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.predicted for r in held) > 10 and all(r.predicted == (r.doc_id % 10 == 0) for r in held)
    stay = toxicity.drop_toxic(docs, labels)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {r.doc_id for r in out if not r.predicted}


def test_hamming_edges(spark):
    """Ids that repeat on both sides, clashing names, an empty table, and fewer rows than k."""
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (2, 7, 5), (3, 0x111110, 5)], "vec_id long, code long, distance int")
    got = hamming_topk.search(df, df.where("vec_id = 1"), 1).collect()
    assert [(r.query_id, r["rank"], r.neighbor_id, r.distance) for r in got] == [(1, 1, 2, 2)]
    got = hamming_topk.search(df, df.where("vec_id = 2"), 9).collect()
    assert sorted((r["rank"], r.neighbor_id, r.distance) for r in got) == [(1, 1, 2), (2, 3, 8)]
    assert hamming_topk.search(df.limit(0), df.limit(0)).collect() == []
    assert hamming_topk.search(df.where("vec_id = 2"), df.where("vec_id = 2")).collect() == []


def test_byte_bpe_of_odd_texts(spark):
    """Texts whose hashes modulo 2**64 agree, long runs, repeated rows, null ids, clashing names and no rows, as digests."""
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    rng = random.Random(10)
    rows = [*enumerate(ODD), (50, one), (51, one.translate(str.maketrans("ab", "ba"))), (52, "".join(rng.choice("etaoin") for _ in range(200_000))), (53, prose(rng, 50_000)), (1, "a b"), (1, "a b"), (None, "a")]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {t: library.encode_ordinary(t or "") for _, t in rows}
    want = Counter((i, len(ids[t]), sha(",".join(map(str, ids[t])).encode()), sha((t or "").encode())) for i, t in rows)
    assert Counter(map(tuple, byte_bpe.digest_documents(table(spark, rows), path).collect())) == want
    assert byte_bpe.digest_documents(table(spark, []), path).collect() == []


@pytest.mark.parametrize("longest, alike", [(4, False), (4096, False), (64, True)])
def test_pre_tokens_in_matrices_and_heaps(longest, alike):
    """Ids do not depend on the length from which a heap is used, nor on hashes: here all may be equal."""
    import tiktoken

    from relspan.llm import tokenize

    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoder = tokenize.Encoder(vars(tokenize.read_ranks(path)), tokenize.unicode_classes(), longest)
    if alike:
        encoder._hashes = lambda data, s, e: np.zeros(len(s), dtype=np.uint64)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for t, i in tokenize.read_ranks(path).whole.items()}, special_tokens={})
    rng = random.Random(11)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abcdeé漢 ") for _ in range(n)) for n in (10, 500, 3000)] + ["ab" * 700]
    ids, off = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]


def test_packing_of_odd_tables(spark):
    path = P.path("word_bpe_49k.json")
    assert packing.pack_documents(table(spark, []), path).collect() == []
    rng = random.Random(12)
    rows = [(1, "a b")] * 5 + [(None, None)] * 3 + [(2, prose(rng, 60_000))]
    out = packing.pack_documents(table(spark, rows), path).collect()
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)
    assert Counter(r.doc_id for r in out if r.start == 0) == Counter(i for i, _ in rows) and max(r.length for r in out) <= 2048


def test_very_long_texts(spark):
    """A text of some 1 MB next to small ones: the same results as for each alone, by what is known of them."""
    rng = random.Random(13)
    long = prose(rng, 150_000, 10**6)
    rows = [(1, long), (2, long + " more"), (3, "short text of a few words"), (4, None), (5, long[1000:3000])]
    docs = table(spark, rows)
    near = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    cut = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs, texts=None).collect()}
    assert cut == {1: (len(long), 1), 2: (len(long), 1), 3: (0, 0), 4: (0, 0), 5: (2000, 1)}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert sorted(r.doc_id for r in score(docs, labels).collect()) == [1, 2, 3, 4, 5]
    assert sum(r["size"] for r in kd_shard.shard_documents(docs).collect()) == sum(len(t or "") + 8 for _, t in rows)
    pages = spark.createDataFrame([(1, "http://a.org/" + "x" * 10**6), (2, "http://" + "b." * 10**5 + "com/fr/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    assert {(r.page_id, r.rule) for r in url_filter.filter_urls(pages, rules).collect()} == {(1, "org/"), (2, "com/fr/")}


def test_minhash_of_all_pairs(spark):
    """With agree=0 every pair of a bucket that may be similar enough is verified."""
    rng = random.Random(15)
    base = prose(rng, 300, 10**6).split()
    rows = [(i, " ".join(base[: 220 + i] + prose(rng, 80 - i, 10**6).split())) for i in range(40)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    for agree in (0, minhash_dedup.AGREE):
        assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(table(spark, rows), agree=agree).collect()} == root


def test_quality_by_hand():
    """The statistics of a text and the walk down the trees, one value at a time."""
    import math

    from relspan.llm._text import Powers, flat_bytes

    texts = ["Plain words here, and words again.\nWords again!\nWords again!", "", "BUY!!! $$$ www ### a" * 3, "é ü x\n\n x"]
    import pyarrow as pa

    x = quality.statistics(*flat_bytes(pa.array(texts)), Powers())
    at = quality.STATISTICS.index
    for row, t in zip(x, texts, strict=True):
        b = t.encode()
        words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), b))
        lines = [s for s in b.split(b"\n") if s]
        n, counts = len(words), Counter(words)
        want = {"upper": sum(65 <= c <= 90 for c in b) / max(len(b), 1), "high": sum(c > 127 for c in b) / max(len(b), 1), "log_bytes": math.log1p(len(b)), "log_words": math.log1p(n)}
        want |= {"word_length": sum(map(len, words)) / max(n, 1), "distinct_words": len(counts) / max(n, 1), "top_word": max(counts.values(), default=0) / max(n, 1)}
        pairs = Counter(zip(words, words[1:], strict=False))
        want |= {"repeated_pairs": sum(c - 1 for c in pairs.values()) / max(n, 1), "log_lines": math.log1p(len(lines)), "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1)}
        for name, value in want.items():
            assert row[at(name)] == pytest.approx(value), (t, name)
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 5))
    y = (data[:, 1] + 0.3 * data[:, 3] > 0.2).astype(float)
    trees = quality.fit(data, y)
    for row, score in zip(data[:50], trees.score(data[:50]), strict=True):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((trees.score(data) >= 0.5) == y).mean() > 0.95


def test_toxicity_by_hand(spark):
    """The ratios of words against the same models made of dictionaries."""
    import math

    from relspan.llm._text import Powers, flat_bytes

    rng = random.Random(16)
    rows = [(i, prose(rng, 30, 60) + (f" bad{i % 3} bad{i % 3}" if i % 4 == 0 else "")) for i in range(200)]
    docs, labels = table(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    learned = toxicity.Toxicity(docs, labels, "doc_id", "text", "toxic", 5, 0, 1)
    counts = [Counter(), Counter()]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 > 1:
            counts[i % 4 == 0].update(set(t.split()))
    total = [sum(c.values()) for c in counts]
    words = set(counts[0]) | set(counts[1])

    def ratios(z):
        over = {w: [max(counts[c][w] - e - z * math.sqrt(e) - toxicity.DISCOUNT, 0) for c in (0, 1) for e in [(counts[0][w] + counts[1][w]) * total[c] / sum(total)]] for w in words}
        spare = [1 - sum(o[c] for o in over.values()) / total[c] for c in (0, 1)]
        shared = {w: (counts[0][w] + counts[1][w] + 0.01) / (sum(total) + 0.01 * (len(words) + 1)) for w in words}
        told = {w: math.log((o[1] / total[1] + shared[w] * spare[1]) / (o[0] / total[0] + shared[w] * spare[0])) for w, o in over.items() if any(o)}
        return told, math.log(spare[1] / spare[0])

    import pyarrow as pa

    models = toxicity.Models(*learned.models.value)
    got, n = models.compare(*flat_bytes(pa.array([t for _, t in rows])), Powers())
    for k, z in enumerate(toxicity.STRICT):
        told, rest = ratios(z)
        assert told or k
        for i, t in rows:
            assert got[i, k] == pytest.approx(sum(told.get(w, rest) for w in t.split()) / n[i], abs=1e-5)


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on planted documents: toxic, poor, near-copied and repeated ones; the chain is done again by hand."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(17)
    clean = lambda n: ". ".join(prose(rng, 12, 10**5).capitalize() for _ in range(n))
    passage, copied = clean(9), clean(20)
    docs, labels = [], []
    for i in range(400):
        toxic, poor = i % 8 == 0, i % 8 == 1
        text = clean(rng.randrange(8, 16)) + (" idiot scum idiot" * 6 if toxic else "") if not poor else "$$$ WIN!!! " * rng.randrange(20, 60)
        if 300 <= i < 330 and not toxic and not poor:
            text = clean(6) + " " + passage + " " + clean(6)
        if 340 <= i < 360 and not toxic and not poor:
            text = copied + f" x{i}"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    docs.append((1000, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read.limit(0), str(tmp_path)).columns == read.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    fine = {i: t for i, t, *_ in docs if i < 1000 and i % 8 > 1}
    first = min(i for i in fine if 340 <= i < 360)
    fine = {i: t for i, t in fine.items() if not 340 <= i < 360 or i == first}
    grams = Counter(t.encode()[k : k + corpus_pipeline.PASSAGE] for t in fine.values() for k in range(len(t.encode()) - corpus_pipeline.PASSAGE + 1))
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for i, t in fine.items():
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - corpus_pipeline.PASSAGE + 1):
            if grams[b[k : k + corpus_pipeline.PASSAGE]] > 1:
                gone[k] += 1
                gone[k + corpus_pipeline.PASSAGE] -= 1
        left = bytes(np.frombuffer(b, np.uint8)[np.cumsum(gone)[:-1] == 0]).decode()
        want[i] = [*library.encode(left, add_special_tokens=False).ids, 1]
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        if r.doc_id < 1000:  # the document without a text may go or stay
            got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(got) == set(want) and len(passage) > corpus_pipeline.PASSAGE
    for i, pieces in got.items():
        assert pieces == [(s, n, zlib.crc32(np.array(want[i][s : s + n], dtype="<u4").tobytes())) for s, n, _ in pieces] and sum(n for _, n, _ in pieces) == len(want[i])


def test_scratch_needs_a_shared_folder():
    """On a cluster no folder of the driver's own is written to."""
    from types import SimpleNamespace

    from relspan.llm._store import shared_root

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))
    assert shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "file:///shared"), sparkContext=context)) == "file:///shared"
