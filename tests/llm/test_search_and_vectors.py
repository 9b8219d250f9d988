"""Whitening, ranked search and byte-level BPE."""

import base64
import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from logweave.llm import bpe, common, ranking, whitening

# ---- whitening ------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, size string, x string, n string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "x", "n", "c") for i, v in rows], VECTORS)


def check_whitening(result, rows, most=16):
    """Against exact covariances and eigenvectors of the same matrix."""
    usable = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    x = [[math.floor(64 * float(np.float32(e))) + 1000000 for e in v] for _, v in usable]
    fit = sorted({tuple(v) for v in x})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[a] for v in fit) for a in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((v[a] - mean[a]) * (v[b] - mean[b]) for v in fit) / n) for b in range(d)]
                    for a in range(d)])
    values = np.linalg.eigh(cov)[0][::-1]
    k = min(most, d)
    got = collections.defaultdict(list)
    for r in result.collect():
        got[r["component"]].append(r)
    assert sorted(got) == list(range(1, k + 1))
    for c in range(1, k + 1):
        assert {r["n"] for r in got[c]} == {n}
        deviation = sorted((repr(i), sum((n * e - s) ** 2 for e, s in zip(v, sums, strict=True)))
                           for (i, _), v in zip(usable, x, strict=True))
        assert sorted((repr(r["vec_id"]), r["deviation"]) for r in got[c]) == deviation
        assert all(math.isclose(r["explained"], values[c - 1] / values.sum(), rel_tol=1e-9, abs_tol=1e-15)
                   for r in got[c])
        assert all(r["identity_error"] < 1e-9 for r in got[c])
    # The covariance of the whitened fit rows is the identity, and each component spans its own eigenvector.
    first = {}
    for (i, _), v in zip(usable, x, strict=True):
        first.setdefault(tuple(v), i)
    by_id = {(repr(r["vec_id"]), c): r["whitened"] for c in got for r in got[c]}
    w = np.array([[by_id[repr(first[v]), c] for c in range(1, k + 1)] for v in fit])
    back = (np.array([[float(e - m) for e, m in zip(v, mean, strict=True)] for v in fit]).T @ w / n)
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-8)
    assert np.allclose(cov @ back, back * values[:k], rtol=1e-6, atol=1e-6 * values[0])


def test_whitening(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").limit(120)
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    check_whitening(whitening.whiten(vectors(spark, rows)), rows)


def test_whitening_of_odd_rows(spark):
    draw = random.Random(3)
    rows = [(k, [draw.gauss(0, 1) for _ in range(5)]) for k in range(40)]
    rows += [(k, rows[0][1]) for k in range(40, 60)] + [(None, rows[1][1]), (7, rows[2][1]), (7, rows[2][1])]
    bad = [(100, None), (101, []), (102, [None] + [1.0] * 4), (103, [float("nan")] * 5),
           (104, [float("inf")] + [0.0] * 4), (105, [1.0, 2.0])]
    distinct = [(i, v) for i, v in rows if i is not None and i < 60]
    result = whitening.whiten(vectors(spark, rows + bad))
    assert {r["vec_id"] for r in result.collect()} == {i for i, _ in rows}
    assert result.count() == 5 * len(rows)
    check_whitening(whitening.whiten(vectors(spark, distinct[:60])), distinct[:60])


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None)] * 4
    flat = whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])])).collect()
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: r["component"])] == [False] * 3 + [True] * 3


def test_whitening_beyond_longs(spark):
    """Squares that no long holds are added up exactly."""
    big = [[1e15, -3e15], [2e15, 5e15], [7e15, 1e15], [-4e15, 2.5e15]]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(big)], "vec_id bigint, embedding array<double>")
    fit, d = whitening.fit_rows(whitening.grid(frame))
    model = whitening.learn(fit, d)
    x = [[math.floor(64 * e) + 1000000 for e in v] for v in big]
    mean = [Fraction(sum(v[a] for v in x), 4) for a in range(2)]
    for a in range(2):
        for b in range(2):
            assert model.covariance[a, b] == float(sum((v[a] - mean[a]) * (v[b] - mean[b]) for v in x) / 4)
    assert {r["deviation"] for r in whitening.whiten(frame).collect()} == {None}


# ---- ranked search --------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute_search(documents, items, top=20):
    words = [(d, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in documents]
    full = sum(1 for _, c in words if c)
    total = sum(sum(c.values()) for _, c in words)
    df = collections.Counter(w for _, c in words for w in c)
    out = []
    for item, text in items:
        asked, found = TERM.findall((text or "").translate(LOWER)), []
        for d, c in words:
            if not c:
                continue
            m = 75 + (25 * sum(c.values()) * full) // total
            score = sum(math.floor(1000 * math.log((2 * full + 2) / (2 * df[w] + 1)))
                        * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in asked if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_search(spark, sf, which, request):
    frame = request.getfixturevalue(which)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(-1, None), (-2, ""), (-3, "!!"), (None, "shared1 SHARED2 w5x5 the The"), (-4, "text text here ÉTÉ été")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = [tuple(r) for r in ranking.search(frame, benchmark).collect()]
    assert sorted(got, key=repr) == brute_search(rows, items)


def test_search_with_ties_and_small_shards(spark, monkeypatch):
    """Many documents tie at the k-th score; blocks and shards are small, and the vocabulary is not held."""
    monkeypatch.setattr(ranking, "ITEMS", 2)
    draw = random.Random(5)
    rows = [(k, " ".join(draw.choice("abcdefgh") for _ in range(draw.choice([3, 3, 3, 9])))) for k in range(900)]
    items = [(k, " ".join(draw.choice("abcdefghij") for _ in range(4))) for k in range(9)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for shard, wanted in ((200, 500_000), (4_000_000, 3)):
        monkeypatch.setattr(ranking, "SHARD", shard)
        monkeypatch.setattr(ranking, "WANTED", wanted)
        got = [tuple(r) for r in ranking.search(frame, asked, top=7).collect()]
        assert sorted(got, key=repr) == brute_search(rows, items, 7)


def test_search_stops_early():
    """A few documents with high impacts settle a search before the lists end."""
    n = 50_000
    tf = np.ones((n, 2), np.int64)
    tf[:30] = 50
    shard = ranking.Shard(np.arange(n), np.full(n, 100), np.full(n, 2), np.tile([0, 1], n), tf.ravel(), [b"a", b"b"], n, 100 * n)
    looked = []
    direct = np.searchsorted
    ranking.np.searchsorted = lambda own, new, **k: (looked.append(len(new)), direct(own, new, **k))[1]
    try:
        found = shard.search([(b"a", 3), (b"b", 2)], 20)
    finally:
        ranking.np.searchsorted = direct
    assert sorted(d for _, d in found) == list(range(20))
    assert sum(looked) < 1000


# ---- byte-level BPE -------------------------------------------------------------


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_digests(public, rows):
    out = []
    for d, t in rows:
        ids = public.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = ["'", " ", "  ", "\n", "\r\n", "'s", "'re", "'ll", "ab", "é", "中", "1", "½", "²", "\x1c", "\x85", "\xa0",
       " ", "!", "?!", "_", "́", "🙂", "‍", "ǅ", "ⅷ", "１", "ʼ", "ɏ", "ɐ", "\t", "X", "the"]


def odd_texts(n=400):
    draw = random.Random(11)
    return ["".join(draw.choice(ODD) for _ in range(draw.randrange(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 256), (400, 60), (20, 6)])
@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_bpe(public, which, chunk, overlap, request):
    frame = request.getfixturevalue(which)
    if chunk < 100 and which == "documents":
        frame = frame.limit(40)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = [tuple(r) for r in bpe.digests(frame, chunk=chunk, overlap=overlap).collect()]
    assert sorted(got, key=repr) == brute_digests(public, rows)


def test_bpe_of_random_texts(spark, public):
    """Runs over several chunks, and boundaries that a chunk's end hides, with chunks of a few characters."""
    rows = list(enumerate(odd_texts() + ["x" * 500, " " * 300 + "y", "a1" * 200, "'" * 200 + "re", "\n" * 99 + "z", "中" * 700]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for chunk, overlap in ((7, 5), (12, 4), (40, 9)):
        got = [tuple(r) for r in bpe.digests(frame, chunk=chunk, overlap=overlap).collect()]
        assert sorted(got, key=repr) == brute_digests(public, rows)


def test_chunks_agree_mostly(spark):
    """Prose is stitched in the overlaps: its chunks are encoded by tasks of their own."""
    text = " ".join(f"word{k} of prose," for k in range(4000))
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    cut = common.written(bpe.chunks(frame, 1000, 50), "test-chunks")
    found = common.written(bpe.pretokens(cut, bpe.default_pattern(), 1000, 50), "test-pretokens")
    stitched = bpe.stitch(found).collect()
    assert len(stitched) == len(range(0, len(text) - 50, 1000))
    assert not any(r["apart"] for r in stitched) and all(0 <= r["cut"] <= 50 for r in stitched)


def test_latin_split_equals_general(public):
    split = bpe.Splitter(bpe.default_pattern())
    for text in [t for t in odd_texts(3000) if not split.other(t)]:
        assert split.latin(text) == split.find(text)


def test_merges_together_equal_one_by_one(public):
    ranks, draw = bpe.Ranks.of(bpe.default_ranks()), random.Random(2)
    tokens = bpe.Tokens(ranks)
    pieces = ["".join(draw.choice("aabcdeothin'é中") for _ in range(draw.randrange(2, 60))).encode() for _ in range(500)]
    together = ranks._together(pieces)
    assert together == [ranks._alone(p) for p in pieces]
    assert tokens.decode(np.frombuffer(b"".join(together), "<i4"))[0].tobytes() == b"".join(pieces)
    assert [np.frombuffer(i, "<i4").tolist() for i in ranks.merge(pieces)] == [
        public._encode_single_piece(p) for p in pieces]
