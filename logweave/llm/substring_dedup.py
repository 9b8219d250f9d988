"""Removal of repeated passages: Rabin-Karp hashes of every window of 50 words.

A window is removed from a document when its words also start in a document with a smaller id; overlapping windows
merge into maximal intervals.  All windows are hashed and judged, but neighbours share their fate, so they are
counted in three steps, each over what the step before left open:

1. *Runs*.  A window's anchor is the smallest hash among its 10-word pieces.  Neighbouring windows with one
   anchor form a run, about twenty windows long; equal windows have equal anchors.  Runs are counted by anchor; an anchor
   in one document only settles all its windows as unique.
2. *Whole runs*.  Runs with a shared anchor are counted by (anchor, hash of the run's words): all windows of a run that
   a smaller id has as well are removed.
3. *Windows*.  Where an anchor has several different runs, the windows of their first documents are counted one by one.

Every step is a min() per key with partial sums before the shuffle and an equi-join back, whose hot keys
(a passage in a third of all documents) Spark splits.  Equality is that of two 64-bit hashes, anchor and window.

* Null texts have no words.  A null id counts as larger than all others.
* Rows that share an id never remove each other's words; each is judged and returned by itself.
* An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common

WIDTH, PIECE = 50, 10
BASE = 0x9E3779B97F4A7C15
#: Its inverse modulo 2**64.
INVERSE = pow(BASE, -1, 1 << 64)
NO_ID = (1 << 63) - 1


class Prefix:
    """Rabin-Karp hashes (modulo 2**64) of any stretch of a list of word hashes."""

    def __init__(self, flat: np.ndarray):
        steps = np.full(len(flat) + 1, INVERSE, np.uint64)
        steps[0] = 1
        down = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = BASE
        self.up = np.cumprod(steps, dtype=np.uint64)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(flat * down[:-1], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        n = max(len(self.sums) - width, 0)
        return common.mix((self.sums[width : width + n] - self.sums[:n]) * self.up[:n])

    def stretches(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        raw = (self.sums[begin + length] - self.sums[begin]) * self.up[begin]
        return common.mix(raw + length.astype(np.uint64))


def anchors(pieces: np.ndarray, width: int, piece: int) -> np.ndarray:
    """Smallest piece hash of each window."""
    reach, level, have = width - piece + 1, pieces, 1
    while have * 2 <= reach:
        level = np.minimum(level[:-have], level[have:])
        have *= 2
    rest = reach - have
    return np.minimum(level[: len(level) - rest], level[rest:]) if rest else level


def runs_of(flat: np.ndarray, ends: np.ndarray, width: int, piece: int):
    """Anchor, hash, document number, start and windows of all runs of a batch."""
    none = np.zeros(0, np.int64)
    if len(flat) < width:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix = Prefix(flat)
    anchor = anchors(prefix.windows(piece), width, piece)
    # Windows that cross the border of two documents don't exist.
    start = np.arange(len(anchor))
    owner = np.searchsorted(ends, start, side="right") - 1
    real = start + width <= ends[owner + 1]
    start, owner, anchor = start[real], owner[real], anchor[real]
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, of = start[first], owner[first]
    return anchor[first], prefix.stretches(begin, count + width - 1), of, begin - ends[of], count


RUNS = ("doc_id bigint, tag bigint, n_words bigint, kept_sha256 string, "
        "runs array<struct<key: bigint, body: bigint, start: int, n: int>>")
RUN_TYPE = pa.list_(pa.struct(
    [("key", pa.int64()), ("body", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
))


def find_runs(documents: DataFrame, width: int, piece: int) -> DataFrame:
    """A row per document: its words' number, their digest, and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = common.WordIds()
        for batch in common.slices(batches, 2 << 20, "words"):
            texts = batch.column("words").to_pylist()
            flat, ends = common.word_hashes(texts, ids)
            key, body, of, start, n = runs_of(flat, ends, width, piece)
            cuts = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            columns = [key.view(np.int64), body.view(np.int64), start.astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("tag"), pa.array(np.diff(ends)),
                pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts], pa.string()),
                pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(
                    [pa.array(c) for c in columns], names=["key", "body", "start", "n"])),
            ], names=["doc_id", "tag", "n_words", "kept_sha256", "runs"])

    return common.arrow_map(documents.select("doc_id", "tag", "words"), run, RUNS)


def shared_runs(found: DataFrame) -> DataFrame:
    """Runs whose anchor stands in two documents at least: doc_id, tag, key, start, n, ``whole``, ``open``.

    ``whole``: a smaller id has the run as well.  ``open``: its windows must be compared one by one.
    """
    runs = found.select("doc_id", "tag", F.explode("runs").alias("r")).select("doc_id", "tag", "r.*")
    keys = runs.groupBy("key").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        (F.min("body") != F.max("body")).alias("several"),
    ).filter("low < high").select("key", "several")
    shared = common.written(runs.join(keys, "key"), "passage-runs")
    first = shared.groupBy("key", "body").agg(F.min("doc_id").alias("first"))
    return shared.join(first, ["key", "body"]).select(
        "doc_id", "tag", "key", "start", "n",
        (F.col("doc_id") > F.col("first")).alias("whole"),
        (F.col("several") & (F.col("doc_id") == F.col("first"))).alias("open"),
    ).filter("whole or open")


def open_windows(involved: DataFrame, width: int) -> DataFrame:
    """doc_id, tag, key, start and hash of each window of the open runs."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("tag", pa.int64()), ("key", pa.int64()), ("start", pa.int32()),
        ("window", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = common.WordIds()
        for batch in common.slices(batches, 1 << 20, "words"):
            for doc_id, tag, text, spans in zip(
                *[batch.column(c).to_pylist() for c in ("doc_id", "tag", "words", "spans")], strict=True
            ):
                spans = [s for s in spans if not s["whole"]]
                if not spans:
                    continue
                flat, _ = common.word_hashes([text], ids)
                hashes = Prefix(flat).windows(width).view(np.int64)
                at = np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in spans])
                key = np.repeat([s["key"] for s in spans], [s["n"] for s in spans])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), doc_id)), pa.array(np.full(len(at), tag)), pa.array(key),
                    pa.array(at.astype(np.int32)), pa.array(hashes[at]),
                ], schema=schema)

    return common.arrow_map(
        involved.filter(F.exists("spans", lambda s: ~s["whole"])).select("doc_id", "tag", "words", "spans"),
        run, "doc_id bigint, tag bigint, key bigint, start int, window bigint",
    )


def remove(involved: DataFrame, width: int) -> DataFrame:
    """doc_id, tag, n_removed, kept_sha256, intervals of the documents with spans to remove."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("tag", pa.int64()), ("n_removed", pa.int64()), ("left_sha256", pa.string()),
        ("intervals", pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2 << 20, "words"):
            rows = []
            for doc_id, tag, text, spans, more in zip(
                *[batch.column(c).to_pylist() for c in ("doc_id", "tag", "words", "spans", "windows")], strict=True
            ):
                words = text.split()
                change = np.zeros(len(words) + 1, np.int64)
                starts = [s["start"] for s in spans if s["whole"]] + (more or [])
                stops = [s["start"] + s["n"] - 1 + width for s in spans if s["whole"]] + [p + width for p in more or []]
                np.add.at(change, starts, 1)
                np.add.at(change, stops, -1)
                covered = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                left = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
                rows.append({
                    "doc_id": doc_id, "tag": tag, "n_removed": int(covered.sum()),
                    "left_sha256": hashlib.sha256(b" ".join(left)).hexdigest(),
                    "intervals": [{"begin": b, "stop": s} for b, s in edges.reshape(-1, 2).tolist()],
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return common.arrow_map(
        involved.select("doc_id", "tag", "words", "spans", "windows"), run,
        "doc_id bigint, tag bigint, n_removed bigint, left_sha256 string, "
        "intervals array<struct<begin: int, stop: int>>",
    )


def substring_dedup(documents: DataFrame, width: int = WIDTH, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed ``intervals`` (word numbers) of every row."""
    rows = documents.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tag"),
        common.as_binary(F.col("text")).alias("words"),
    )
    found = common.written(find_runs(rows, width, piece), "passage-documents")
    per_document = common.written(
        shared_runs(found).groupBy("doc_id", "tag").agg(
            F.collect_list(F.struct("key", "start", "n", "whole")).alias("spans")
        ),
        "passage-spans",
    )
    involved = common.written_matches(rows, per_document, ["doc_id", "tag"], "passage-involved")
    windows = common.written(open_windows(involved, width), "passage-windows")
    first = windows.groupBy("key", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = (
        windows.join(first.filter("first < last"), ["key", "window"]).filter("doc_id > first")
        .groupBy("doc_id", "tag").agg(F.collect_list("start").alias("windows"))
    )
    removed = remove(involved.join(repeated, ["doc_id", "tag"], "left"), width).dropDuplicates(["doc_id", "tag"])
    none = F.array().cast("array<struct<begin: int, stop: int>>")
    return found.drop("runs").join(removed, ["doc_id", "tag"], "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("left_sha256", "kept_sha256").alias("kept_sha256"),
        F.coalesce("intervals", none).alias("intervals"),
    )
