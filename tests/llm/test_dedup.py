"""Exact, substring and near deduplication against brute force."""

import collections
import hashlib

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import common, exact_dedup, near_dedup, substring_dedup
from logweave.llm.components import components


def saved(spark, frame):
    path = common.shared_folder(spark, "table")
    frame.write.parquet(path)
    return path


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def brute_exact(rows, digest):
    top = 1 << 63
    texts = [helpers.GAP.sub(" ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (d, _), t in zip(rows, texts, strict=True):
        groups[t].append(top if d is None else d)
    return sorted(
        (repr(d), repr(None if min(groups[t]) == top else min(groups[t])), len(groups[t]),
         (top if d is None else d) == min(groups[t]), digest(t))
        for (d, _), t in zip(rows, texts, strict=True)
    )


def as_rows(frame):
    return sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["kept"], r["digest"])
                  for r in frame.collect())


def test_exact_odd(spark, odd):
    got = exact_dedup.exact_dedup(spark, saved(spark, odd))
    want = brute_exact(pairs(odd), lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert as_rows(got) == want


def test_exact_empty(spark, empty):
    assert exact_dedup.exact_dedup(spark, saved(spark, empty)).count() == 0


def test_exact_checks_bytes(spark, documents):
    """A digest of two characters: texts that share it are told apart by their bytes."""
    some = documents.filter("doc_id < 60")
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    got = exact_dedup.exact_dedup(spark, saved(spark, some), digest=weak)
    want = brute_exact(pairs(some), lambda t: hashlib.sha256(t.encode()).hexdigest()[:1])
    assert as_rows(got) == want


def test_exact_state_lasts(spark, documents):
    """A second run over new files finds copies of the first run's rows, and only reads the new files."""
    path, state = common.shared_folder(spark, "grown"), common.shared_folder(spark, "state")
    documents.filter("doc_id % 2 = 0").write.parquet(path)
    exact_dedup.exact_dedup(spark, path, state, files_per_batch=1)
    documents.filter("doc_id % 2 = 1").write.mode("append").parquet(path)
    got = exact_dedup.exact_dedup(spark, path, state)
    want = brute_exact(pairs(documents), lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert as_rows(got) == want


@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_substring(which, request):
    frame = request.getfixturevalue(which)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])
           for r in substring_dedup.substring_dedup(frame).collect()]
    assert sorted(got, key=repr) == sorted(helpers.brute_substring(pairs(frame)), key=repr)


def test_substring_hot_passage(spark):
    """A passage in most rows, in different surroundings, and a run of one word."""
    rows = [helpers.row(k, f"x{k} " * (k % 7) + helpers.PASSAGE + f" y{k % 5}" * (k % 60)) for k in range(120)]
    rows += [helpers.row(200 + k, "of " * (49 + k)) for k in range(4)]
    frame = spark.createDataFrame(rows, helpers.SCHEMA)
    result = substring_dedup.substring_dedup(frame).collect()
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result]
    assert sorted(got) == sorted(helpers.brute_substring(pairs(frame)))
    assert all(sum(i["stop"] - i["begin"] for i in r["intervals"]) == r["n_removed"] for r in result)


def test_rolling_hashes_agree():
    flat = np.random.default_rng(1).integers(0, 1 << 63, 300, np.uint64)
    prefix = substring_dedup.Prefix(flat)
    windows = prefix.windows(50)
    again = substring_dedup.Prefix(flat[70:]).windows(50)
    assert len(windows) == 251 and (windows[70:] == again).all()
    assert len(set(common.rolling(flat, 5).tolist())) == 296


@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_near(which, request):
    frame = request.getfixturevalue(which)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(frame).collect()]
    assert sorted(got, key=repr) == sorted(helpers.brute_near(pairs(frame)), key=repr)


def variants(random, count, edits, length=120):
    base = [f"v{x}" for x in random.integers(0, 10_000, length)]
    for k in range(count):
        words = list(base)
        for p in random.integers(0, length, random.integers(0, edits)):
            words[p] = f"e{k}-{p}"
        yield " ".join(words)


def test_near_large_groups(spark):
    """Groups whose members are partly just above and partly just below the threshold."""
    random = np.random.default_rng(3)
    texts = [t for edits in (3, 5, 8) for t in variants(random, 150, edits)]
    frame = spark.createDataFrame([helpers.row(k, t) for k, t in enumerate(texts)], helpers.SCHEMA)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(frame).collect()]
    assert sorted(got) == sorted(helpers.brute_near(pairs(frame)))


def test_keep_first(spark, odd, empty):
    left = near_dedup.keep_first(odd)
    ids = sorted((r["doc_id"] for r in left.collect()), key=repr)
    # 1, 2, 2 are one group, 6 and 7 another, 8 to 10 another; "a" equals "A"; rows without words all stay.
    assert left.columns == odd.columns
    assert ids == sorted([1, 3, 4, 5, None, 6, 8, 11, 13, None, 14, 15] + [
        d for d in (9, 10) if d not in (8,) and helpers.brute_near(pairs(odd))[
            [p[0] for p in pairs(odd)].index(d)][2] == d], key=repr)
    assert near_dedup.keep_first(empty).count() == 0


def test_sketches_merge_and_estimate():
    random = np.random.default_rng(7)
    for shared in (0.5, 0.85, 0.95):
        a = random.integers(0, 1 << 63, 2000, np.uint64)
        n = int(2000 * 2 * shared / (1 + shared))
        b = np.concatenate([a[:n], random.integers(0, 1 << 63, 2000 - n, np.uint64)])
        x, y = near_dedup.sketch(a), near_dedup.sketch(b)
        both = near_dedup.sketch(np.union1d(a, b))
        assert (near_dedup.merge(x, y) == both).all()
        guess = near_dedup.likely(x[None], y[None], np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(guess - shared) < 0.12


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert len({got[k] for k in range(41)}) == 1 and len({got[k] for k in range(100, 140)}) == 1
    assert got[0] != got[100]
