"""Documents that hold benchmark items, found by the CGK embedding.

Words are compared without case and punctuation.  A window of a document as long as an item matches it if their
edit distance in words is at most ``RATE`` of the item's words.  The CGK walk maps a sequence to three times as many
symbols: each step emits the current word and moves on if a random bit of (step, word) says so; sequences
a few edits apart then differ in few places.  Each repetition samples ``SAMPLED`` of the first two thirds of those
places as a bucket key (the rest mostly follows the last word); a walk that has left the sequence at one of them has no
bucket there.  A window and an item of its length that share a key in any repetition are compared exactly.

* Repetitions: for each length of items as many as these need for the target recall at the largest distance allowed.
* The buckets are the index: a window's keys are looked up among those of all items of its length, and the items
  found there are its only candidates.
* Windows that can't match any item of their length are not embedded: a match shares enough runs of ``q`` words with
  its item, each within ``k`` words of its place there.  That loses none: ``k`` edits touch at most ``k * q`` of the ``n - q + 1`` runs
  of an item of ``n`` words.
* Items of fewer than ``LEAST`` words allow no edit; they are looked up by the hash of all their words and compared
  word by word.  Items without a word (null and empty ones, too) match nothing.
* Items go to the executors in blocks of at most ``BLOCK`` items and about ``BLOCK_WORDS`` words, each block against
  all documents.
* Null texts have no words and match nothing.  Null ids stay null; repeated rows each give their own matches.
* Empty tables give an empty result; extra columns are ignored.  Of several windows that match an item, the one with the
  least distance is reported, then the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common

RATE, SAMPLED, BLOCK = 0.2, 3, 20_000
#: Words of the shortest item that allows an edit.
LEAST = 5
#: Words of a block of items; with their keys and runs, some 200 bytes a word in a Python worker.
BLOCK_WORDS = 1_000_000
TARGET_RECALL = 0.99
#: Edited copies at least that the repetitions of a length are measured on.
TRIALS = 1000
ROUND = 8


_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class Forms(common.WordIds):
    """Hash of a word without case and punctuation; 0 if nothing is left."""

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(_MARKS).lower()
        if not plain.isalnum():  # bytes: ASCII letters and digits only
            plain = "".join(filter(str.isalnum, word.decode("utf-8", "replace").lower())).encode()
        self[word] = h = (xxhash.xxh3_64_intdigest(plain) | 1) if plain else 0
        return h


def word_forms(texts: list[bytes], forms: Forms) -> tuple[np.ndarray, np.ndarray]:
    flat, ends = common.word_hashes(texts, forms)
    real = flat != 0
    return flat[real], np.concatenate([[0], np.cumsum(real)])[ends]


def walk(sequences: np.ndarray, places: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Bucket keys (sequences x repetitions); ``places``: repetitions x sampled steps; 0 pads a sequence.

    The key is 0, no bucket, where a sampled step stands past the words.
    """
    count, length = sequences.shape
    padded = np.concatenate([sequences, np.zeros((count, 1), np.uint64)], axis=1)
    rows = np.arange(count)[:, None]
    at = np.zeros((count, len(seeds)), np.int64)
    keys = np.broadcast_to(seeds, at.shape).copy()
    inside = np.ones(at.shape, bool)
    for step in range(int(places.max()) + 1):
        now = padded[rows, np.minimum(at, length)]
        taken = (places == step).any(axis=1)
        if taken.any():
            keys[:, taken] = common.mix(keys[:, taken] * np.uint64(31) + now[:, taken])
            inside[:, taken] &= now[:, taken] != 0
        at += (common.mix(now + seeds * np.uint64(2 * step + 1)) & np.uint64(1)).astype(np.int64)
    return np.where(inside, keys | np.uint64(1), np.uint64(0))


def plan(length: int, repetitions: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps and seeds of all repetitions for sequences of a length."""
    random = np.random.default_rng([seed, length])
    places = np.stack([random.choice(2 * length, min(SAMPLED, 2 * length), replace=False)
                       for _ in range(repetitions)])
    return places, random.integers(1, 1 << 63, repetitions, np.uint64)


def rounds(length: int, repetitions: int) -> tuple[np.ndarray, np.ndarray]:
    """The plan in rounds of ``ROUND`` repetitions, so that more repetitions begin with the same ones."""
    parts = [plan(length, ROUND, 9 + k) for k in range(-(-repetitions // ROUND))]
    places, seeds = (np.concatenate(v) for v in zip(*parts, strict=True))
    return places[:repetitions], seeds[:repetitions]


def distances(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of a (padded with 0, of the given lengths) and b."""
    n = b.shape[1]
    steps = np.arange(n + 1)
    row = np.broadcast_to(steps, (len(a), n + 1)).copy()
    result = row[:, n].copy()
    for i in range(a.shape[1]):
        best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i, None] != b))
        best = np.concatenate([row[:, :1] + 1, best], axis=1)
        row = np.minimum.accumulate(best - steps, axis=1) + steps
        result = np.where(lengths == i + 1, row[:, n], result)
    return result


def edited(words: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """A window of an item's length (padded with 0) after the largest number of random edits allowed."""
    changed, edits = words.tolist(), int(RATE * len(words))
    kinds, fresh = random.integers(3, size=edits).tolist(), random.integers(1, 1 << 62, edits).tolist()
    for kind, new, at in zip(kinds, fresh, random.random(edits).tolist(), strict=True):
        p = int(at * len(changed))
        if kind == 0:
            changed[p] = new
        elif kind == 1:
            changed.insert(p, new)
        else:
            del changed[p]
    window = np.zeros(len(words), np.uint64)
    cut = changed[: len(words)]
    window[: len(cut)] = cut
    return window


def repetitions_for(items: list[np.ndarray], target: float, seed: int = 4) -> int:
    """So many that items of one length, at the largest distance, meet one bucket with the target's chance.

    Measured on edited copies of all items, ``TRIALS`` at least, with the very repetitions of ``rounds``.
    """
    random, length = np.random.default_rng(seed), len(items[0])
    left = [words for words in items for _ in range(-(-TRIALS // len(items)))]
    most = int((1 - target) * len(left))
    left = np.stack([np.stack([words, edited(words, random)]) for words in left])
    done = 0
    while True:
        places, seeds = (v[done:] for v in rounds(length, done + ROUND))
        pairs = [
            (walk(part[:, 0], places, seeds), walk(part[:, 1], places, seeds))
            for part in np.array_split(left, -(-len(left) // 512))
        ]
        met = np.concatenate([(a == b) & (a != 0) for a, b in pairs])
        unmet = (~np.logical_or.accumulate(met, axis=1)).sum(axis=0)
        if unmet[-1] <= most:
            return done + int(np.argmax(unmet <= most)) + 1
        left, done = left[~met.any(axis=1)], done + ROUND


def repetitions_by_length(items: list[tuple[int, np.ndarray]], target: float = TARGET_RECALL) -> dict[int, int]:
    by_length: dict[int, list[np.ndarray]] = {}
    for _, words in items:
        if len(words) >= LEAST:
            by_length.setdefault(len(words), []).append(words)
    return {n: repetitions_for(same, target) for n, same in by_length.items()}


class Buckets:
    """Bucket keys of the items of one length, sorted in each repetition."""

    def __init__(self, items: np.ndarray, words: np.ndarray, repetitions: int):
        self.items, self.words = items, words
        self.places, self.seeds = rounds(words.shape[1], repetitions)
        keys = walk(words, self.places, self.seeds).T
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def lookup(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (window, place of an item in ``items``) that share a key in any repetition."""
        mine, pairs = walk(windows, self.places, self.seeds), []
        for r, keys in enumerate(self.keys):
            low = np.searchsorted(keys, mine[:, r], side="left")
            count = np.searchsorted(keys, mine[:, r], side="right") - low
            count[mine[:, r] == 0] = 0
            window = np.repeat(np.arange(len(windows)), count)
            post = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(window))
            pairs.append(window * len(self.items) + self.order[r][post])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.items), both % len(self.items)


class Index:
    """Buckets of items by their length, the runs of words that a match can't lack, and hashes of short items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], repetitions: dict[int, int] | None = None):
        self.items = items
        words = [w for _, w in items]
        self.edits = np.array([int(RATE * len(w)) for w in words], np.int64)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.by_length = {
            n: np.flatnonzero(self.lengths == n) for n in sorted(set(self.lengths.tolist()))
        }
        #: By length: hashes of whole short items, sorted, and their numbers.
        self.short = {}
        for n in [n for n in self.by_length if n < LEAST]:
            which = self.by_length.pop(n)
            hashes = np.concatenate([common.rolling(words[k], n) for k in which])
            order = np.argsort(hashes, kind="stable")
            self.short[n] = (hashes[order], which[order])
        long = np.flatnonzero(self.lengths >= LEAST)
        self.q = int(min([3, *(self.lengths[long] // (self.edits[long] + 1))]))
        #: Runs of q words that a window within the edits shares with its item at least.
        self.needed = np.maximum(self.lengths + 1 - self.q * (self.edits + 1), 1)
        self.repetitions = repetitions or repetitions_by_length(items)
        self.buckets = {
            n: Buckets(which, np.stack([words[k] for k in which]), self.repetitions[n])
            for n, which in self.by_length.items()
        }
        grams = [common.rolling(words[k], self.q) for k in long]
        gram = np.concatenate([np.empty(0, np.uint64), *grams])
        of = np.repeat(long, [len(g) for g in grams])
        offset = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(gram, kind="stable")
        self.gram, self.of, self.offset = gram[order], of[order], offset[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.gram & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def windows(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (length, document, start) of all windows that share enough runs with an item of their length."""
        hashes = common.rolling(flat, self.q)
        at = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        low = np.searchsorted(self.gram, hashes[at], side="left")
        count = np.searchsorted(self.gram, hashes[at], side="right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        owner = np.searchsorted(ends, at, side="right") - 1
        inside = at + self.q <= ends[owner + 1]
        at, low, count, owner = at[inside], low[inside], count[inside], owner[inside]
        post = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, owner = self.of[post], np.repeat(owner, count)
        centre = np.repeat(at, count) - self.offset[post] - ends[owner]
        order = np.lexsort([centre, item, owner])
        owner, item, centre = owner[order], item[order], centre[order]
        # Hits i to last[i] would be those of one window.
        last = np.arange(len(item)) + self.needed[item] - 1
        k = np.flatnonzero(last < len(item))
        last = last[k]
        k_ok = (
            (owner[last] == owner[k]) & (item[last] == item[k])
            & (centre[last] - centre[k] <= 2 * self.edits[item[k]])
        )
        k, last = k[k_ok], last[k_ok]
        edits, size = self.edits[item[k]], ends[owner[k] + 1] - ends[owner[k]]
        first = centre[last] - edits
        spread = centre[k] + edits - first + 1
        each = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
        start = np.clip(np.repeat(first, spread) + each, 0, np.repeat(np.maximum(size - 1, 0), spread))
        return np.unique(np.stack([
            np.repeat(self.lengths[item[k]], spread), np.repeat(owner[k], spread), start
        ], axis=1), axis=0)

    def short_matches(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Document number, item number and start of every whole short item."""
        for n, (hashes, which) in self.short.items():
            mine = common.rolling(flat, n)
            low = np.searchsorted(hashes, mine, side="left")
            count = np.searchsorted(hashes, mine, side="right") - low
            for at in np.flatnonzero(count).tolist():
                owner = int(np.searchsorted(ends, at, side="right")) - 1
                for item in which[low[at] : low[at] + count[at]].tolist():
                    if at + n <= ends[owner + 1] and (flat[at : at + n] == self.items[item][1]).all():
                        yield owner, item, at - int(ends[owner])

    def matches(self, flat: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Document number, item, start and distance of each best match."""
        best: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(document: int, item: int, distance: int, start: int) -> None:
            value = (distance, start)
            if value < best.get((document, item), (distance + 1, 0)):
                best[document, item] = value

        for document, item, start in self.short_matches(flat, ends):
            offer(document, item, 0, start)
        found = self.windows(flat, ends) if self.buckets else np.empty((0, 3), np.int64)
        padded = np.concatenate([flat, np.zeros(1, np.uint64)])
        for n, buckets in self.buckets.items():
            all_rows = found[found[:, 0] == n]
            for k in range(0, len(all_rows), 2048):
                _, owner, start = all_rows[k : k + 2048].T
                begin = ends[owner] + start
                size = np.minimum(ends[owner + 1] - begin, n)
                steps = np.arange(n)
                window = padded[np.where(steps < size[:, None], begin[:, None] + steps, len(flat))]
                w, place = buckets.lookup(window)
                for p in range(0, len(w), 4096):
                    of, to = w[p : p + 4096], place[p : p + 4096]
                    apart = distances(window[of], buckets.words[to], size[of])
                    for x in np.flatnonzero(apart <= int(RATE * n)):
                        offer(int(owner[of[x]]), int(buckets.items[to[x]]), int(apart[x]), int(start[of[x]]))
        return [(d, self.items[i][0], s, a) for (d, i), (a, s) in best.items()]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, np.ndarray]], dict[int, int]]]:
    """The items in blocks of bounded size, with the repetitions of each length of items."""
    forms = Forms()
    size = benchmark.agg(F.count(F.lit(1)).alias("items"), F.sum(common.word_count(F.col("text"))).alias("words")).first()
    parts = max(-(-size["items"] // BLOCK), -(-(size["words"] or 0) // BLOCK_WORDS))
    for part in range(parts):
        mine = benchmark.select("item_id", common.as_binary(F.col("text")).alias("words")).filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part
        )
        items = []
        for row in sorted(mine.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["words"])):
            words, _ = word_forms([bytes(row["words"])], forms)
            if len(words):
                items.append((row["item_id"], words))
        if items:
            yield items, repetitions_by_length(items)


#: The last block that this Python worker met, held so that its identity stays its own, and its index.
_LAST: list = []


def _index(shared) -> Index:
    """The index of a broadcast block, built once per Python worker."""
    block = shared.value
    if not _LAST or _LAST[0] is not block:
        _LAST[:] = [block, Index(*block)]
    return _LAST[1]


MATCHES = "doc_id bigint, tag bigint, item_id bigint, start int, distance int, n_words int"


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, tag, item_id, start (word number), distance, n_words (of the item): a row per match."""
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.xxhash64("text").alias("tag"), common.as_binary(F.col("text")).alias("words"))

    def against(block: tuple[list[tuple[int, np.ndarray]], dict[int, int]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, forms = _index(shared), Forms()
            sizes = dict(zip([i for i, _ in index.items], index.lengths.tolist(), strict=True))
            for batch in common.slices(batches, 2 << 20, "words"):
                flat, ends = word_forms(batch.column("words").to_pylist(), forms)
                ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
                yield pa.RecordBatch.from_pylist([
                    {"doc_id": ids[d], "tag": tags[d], "item_id": i, "start": s, "distance": a, "n_words": sizes[i]}
                    for d, i, s, a in index.matches(flat, ends)
                ], pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("item_id", pa.int64()),
                              ("start", pa.int32()), ("distance", pa.int32()), ("n_words", pa.int32())]))

        return common.arrow_map(rows, run, MATCHES)

    found = [against(block) for block in _blocks(benchmark)]
    if not found:
        return spark.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionByName, found)


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, with their own columns; each block of items is one pass without a shuffle."""
    spark, clean = documents.sparkSession, documents
    for block in _blocks(benchmark):
        clean = common.arrow_map(clean, _clean_rows(spark.sparkContext.broadcast(block)), documents.schema)
    return clean


def _clean_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, forms = _index(shared), Forms()
        for batch in common.slices(batches, 2 << 20, "text"):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            leaks = {d for d, *_ in index.matches(*word_forms(texts, forms))}
            yield batch.filter(pa.array([k not in leaks for k in range(len(texts))], pa.bool_()))

    return run
