"""Byte-level BPE over overlapping chunks.

A text of more than ``chunk`` code points is cut into chunks that overlap by ``overlap``.  Each chunk is split into
pre-tokens by itself, in a task of its own.  A split depends only on what follows it, so where two neighbours have
a boundary in common inside their overlap, both agree from there on: the left one's pre-tokens count up to
the first such boundary, the right one's from it.  Neighbours that have none in common (a run of one kind of
characters longer than the overlap) are joined: such a text is split again in order, chunk by chunk.  Then the pieces are encoded, each pre-token
by itself.  Shorter texts are one chunk.  Decoding concatenates the bytes of the ids.

The end of a chunk may cut a pre-token or hide what its pattern looks ahead to, so boundaries closer than ``LOOK`` code
points to the end count only in the last chunk.  That suits patterns whose alternatives look no further past their end than that.

* A null text counts as empty and has no ids.  Null and repeated ids, and repeated rows, keep a row each.
* An empty table gives an empty result; extra columns are ignored.
* A pre-token is encoded by one task, as its merges depend on one another; only its own length bounds it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import common

CHUNK, OVERLAP = 1 << 16, 1 << 8
#: Code points behind a boundary that must be seen before it is certain: ``'re`` is the longest look.
LOOK = 3
#: A merge's rank where there is none.
NEVER = 1 << 62


# ---- pre-tokens -----------------------------------------------------------------


class Splitter:
    """Pre-tokens of a text by a pattern."""

    #: Up to here, letters, numbers and white space are the fixed ranges below.
    LATIN_END = "ɏ"
    LATIN = {
        r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ",
        r"\p{N}": "0-9²³¹¼½¾",
        r"\s": "\t-\r \x85\xa0",
    }

    def __init__(self, pattern: str):
        import regex

        # Unicode's white space; Python's own \s has four control characters more.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.latin = None
        import public_tokenizers

        if pattern == public_tokenizers.PATTERN:  # the same pattern in Python's faster dialect, for Latin texts
            letter, number, space = self.LATIN.values()
            self.latin = re.compile(
                f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
                f"|[{space}]+(?![^{space}])|[{space}]+").findall
            self.other = re.compile(f"[^\x00-{self.LATIN_END}]").search

    def split(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or not self.other(text)):
            return self.latin(text)
        return self.find(text)


# ---- merges ---------------------------------------------------------------------


class Ranks:
    """Merges by rank, as of a ``.tiktoken`` file: a token in base64 and its rank in each line.

    Ids travel as little-endian bytes of 32 bits.
    """

    #: Pieces of more bytes are merged one by one, with a heap.
    SHORT = 64

    def __init__(self, path: str, most: int = 1 << 18):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        self.most, self.known = most, {}
        # Every two tokens that join to a token, and its rank.
        get, found = self.ranks.get, []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = get(token[:k]), get(token[k:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.pairs, self.joined = np.append(table[:, 0], NEVER), np.append(table[:, 1], NEVER)
        self.bytes = np.array([get(bytes([b]), NEVER) for b in range(256)], np.int64)

    @classmethod
    @lru_cache(maxsize=2)
    def of(cls, path: str) -> Ranks:
        """The same for all tasks of a worker process, with what it has remembered."""
        return cls(path)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], NEVER)

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many short pieces: in each round every piece makes its next merge, the leftmost of lowest rank."""
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.full(len(ids), NEVER)
        rank[:-1] = np.where(own[1:] == own[:-1], self._rank(ids[:-1], ids[1:]), NEVER)
        done = []
        while len(ids):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            live = low < NEVER
            if not live.all():
                done.append((own[~live], ids[~live]))
                ids, own, rank, low = ids[live], own[live], rank[live], low[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == low)
            at = at[np.append(True, own[at][1:] != own[at][:-1])]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, own, rank = ids[keep], own[keep], rank[keep]
            at -= np.arange(len(at))  # each piece before lost one
            for k in (at, at[at > 0] - 1):
                after = np.minimum(k + 1, len(ids) - 1)
                rank[k] = np.where((after > k) & (own[after] == own[k]), self._rank(ids[k], ids[after]), NEVER)
        own = np.concatenate([o for o, _ in done])
        order = np.argsort(own, kind="stable")
        data = np.concatenate([i for _, i in done])[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(own, minlength=len(pieces)))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _alone(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, with a heap of merges."""
        get, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [get(piece[k : k + 2], NEVER) for k in range(n)]
        rank[n - 1] = NEVER
        heap = [(r, k) for k, r in enumerate(rank) if r != NEVER]
        heapq.heapify(heap)

        def again(k: int) -> None:
            middle = after[k]
            rank[k] = get(piece[k : after[middle]], NEVER) if middle < n else NEVER
            if rank[k] != NEVER:
                heapq.heappush(heap, (rank[k], k))

        while heap:
            r, k = heapq.heappop(heap)
            if rank[k] != r:
                continue
            gone = after[k]
            after[k], rank[gone] = after[gone], NEVER
            if after[k] < n:
                before[after[k]] = k
            again(k)
            if before[k] >= 0:
                again(before[k])
        out, k = [], 0
        while k < n:
            out.append(self.ranks[piece[k : after[k]]])
            k = after[k]
        return np.array(out, "<i4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens: the neighbours of lowest rank merge first, the leftmost of equals."""
        out: list = [None] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) <= self.SHORT:
                short.append(k)
            else:
                out[k] = self._alone(piece)
        if short:
            for k, ids in zip(short, self._together([pieces[k] for k in short]), strict=True):
                out[k] = ids
        return out

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts, given as their pre-tokens."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        new = set()
        for pieces in texts:
            new.update(filterfalse(known.__contains__, pieces))
        new = list(new)
        known.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
        for piece in new:  # long ones are not worth remembering
            if len(piece) > self.SHORT:
                del known[piece]
        return out


class Tokens:
    """The bytes of every id, for decoding."""

    def __init__(self, ranks: Ranks):
        size = max(ranks.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.ranks.items():
            tokens[rank] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and where each id's end."""
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids):
            return np.empty(0, np.uint8), ends
        at = np.repeat(self.start[ids] - (ends - length), length)
        at += np.arange(len(at))
        return self.data[at], ends


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


# ---- jobs -----------------------------------------------------------------------

IDS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int32()))])
IDS_TYPE = "doc_id bigint, tag bigint, part bigint, ids array<int>"
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("tag", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("text", pa.string()),
    ("lengths", pa.list_(pa.int32())), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32())),
])
PIECES_TYPE = ("doc_id bigint, tag bigint, part bigint, last boolean, text string, lengths array<int>, "
               "head array<int>, tail array<int>")


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(
        pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4").astype(np.int32)))


def _ids(rows: list[tuple]) -> pa.RecordBatch:
    """Of tuples of doc_id, tag, part and ids."""
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(IDS)
    keys = [pa.array(c, pa.int64()) for c in columns[:3]]
    return pa.RecordBatch.from_arrays([*keys, _lists(columns[3])], schema=IDS)


def _whole(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Texts of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, splitter = Ranks.of(ranks), Splitter(pattern)
        for batch in common.slices(batches, 2 << 20, "text"):
            ids = merges.encode([splitter.split(t or "") for t in batch.column("text").to_pylist()])
            none = pa.array(np.zeros(len(ids), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), none, none, _lists(ids)], schema=IDS)

    return common.arrow_map(documents.select("doc_id", "text"), run, IDS_TYPE)


def chunks(documents: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """doc_id, part, last, text: every text in chunks of ``chunk`` code points and the overlap with the next."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("row", pa.int64()), ("last", pa.bool_()),
                        ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in common.slices(batches, 4 << 20, "text"):
            for doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text")], strict=True):
                starts = range(0, max(len(text) - overlap, 1), chunk)
                for first in range(0, len(starts), 64):
                    some = starts[first : first + 64]
                    yield pa.RecordBatch.from_pylist([
                        {"doc_id": doc_id, "part": s // chunk, "row": row, "last": s == starts[-1],
                         "text": text[s:] if s == starts[-1] else text[s : s + chunk + overlap]}
                        for s in some], schema)
                row += 1

    # Rows of a document share a number that only their task gives out.
    cut = common.arrow_map(documents.select("doc_id", "text"), run,
                           "doc_id bigint, part bigint, row bigint, last boolean, text string")
    tag = F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("row")
    return cut.select("doc_id", tag.alias("tag"), "part", "last", "text")


def pretokens(pieces: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Lengths of each chunk's pre-tokens, and its boundaries inside the overlaps with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern)
        for batch in common.slices(batches, 2 << 20, "text"):
            rows = []
            for row in batch.to_pylist():
                found = [len(p) for p in splitter.split(row["text"])]
                edges = list(accumulate(found))
                sure = len(row["text"]) - (0 if row["last"] else LOOK)
                while edges and edges[-1] > sure:
                    edges.pop()
                rows.append({
                    "doc_id": row["doc_id"], "tag": row["tag"], "part": row["part"], "last": row["last"],
                    "text": row["text"],
                    "lengths": found[: len(edges)],
                    "head": [0, *[e for e in edges if e <= overlap]] if row["part"] else [0],
                    "tail": [] if row["last"] else [e - chunk for e in edges if e >= chunk],
                })
            yield pa.RecordBatch.from_pylist(rows, PIECES)

    return common.arrow_map(pieces.select("doc_id", "tag", "part", "last", "text"), run, PIECES_TYPE)


def stitch(found: DataFrame) -> DataFrame:
    """tag, part, ``cut`` (where the chunk takes over from its left neighbour), ``stop`` (where its right one does).

    Both count from the chunk's start; a null ``stop`` is the text's end.  ``apart`` marks texts in which two neighbours
    have no boundary in common.
    """
    left = found.select("tag", (F.col("part") + 1).alias("part"), "tail")
    # The first boundary that both have; a text's first chunk begins at 0.
    cuts = found.select("tag", "part", "head").join(left, ["tag", "part"], "left").select(
        "tag", "part",
        F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "tail"))).alias("cut"),
    )
    # Rows of a few numbers for each chunk.
    text = Window.partitionBy("tag")
    return cuts.select(
        "tag", "part", "cut", F.lead("cut").over(text.orderBy("part")).alias("stop"),
        F.max(F.col("cut").isNull()).over(text).alias("apart"),
    )


def _sure_pieces(rows: DataFrame, ranks: str, chunk: int) -> DataFrame:
    """Ids of chunks whose neighbours agree: the pre-tokens between the two cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Ranks.of(ranks)
        for batch in common.slices(batches, 1 << 20, "text"):
            out, texts = [], []
            for row in batch.to_pylist():
                text, edges = row["text"], list(accumulate(row["lengths"], initial=0))
                stop = len(text) if row["stop"] is None else chunk + row["stop"]
                edges = [e for e in edges if row["cut"] <= e <= stop]
                texts.append([text[a:b] for a, b in zip(edges, edges[1:], strict=False)])
                out.append((row["doc_id"], row["tag"], row["part"]))
            yield _ids([(*o, ids) for o, ids in zip(out, merges.encode(texts), strict=True)])

    return common.arrow_map(rows.select("doc_id", "tag", "part", "text", "lengths", "cut", "stop"), run, IDS_TYPE)


def _in_order(rows: DataFrame, ranks: str, pattern: str, chunk: int) -> DataFrame:
    """Ids of texts with neighbours that don't agree: their chunks are joined and split one after the other.

    What follows the last sure boundary is carried on, so a task holds a chunk and one pre-token at most, and
    looks at a long pre-token again only when twice as much of it is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, splitter = Ranks.of(ranks), Splitter(pattern)
        carry, length, need = [], 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                carry.append(row["text"] if row["last"] else row["text"][:chunk])
                length += len(carry[-1])
                pieces = []
                if row["last"] or length >= need:
                    text = "".join(carry)
                    pieces = splitter.split(text)
                    at = len(text)
                    while pieces and not row["last"] and at > len(text) - LOOK:
                        at -= len(pieces.pop())
                    carry, length = [text[at:]], len(text) - at
                    need = 2 * length
                out.append((row["doc_id"], row["tag"], row["part"], merges.encode([pieces])[0]))
                if row["last"]:
                    carry, length, need = [], 0, 0
            yield _ids(out)

    ordered = rows.repartition("tag").sortWithinPartitions("tag", "part")
    return common.arrow_map(ordered.select("doc_id", "tag", "part", "last", "text"), run, IDS_TYPE)


def _long(documents: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Texts of several chunks: a row of ids for each chunk."""
    cut = common.written(chunks(documents, chunk, overlap), "bpe-chunks")
    found = common.written(pretokens(cut.repartition("tag", "part"), pattern, chunk, overlap), "bpe-pretokens")
    rows = found.join(common.written(stitch(found), "bpe-cuts"), ["tag", "part"])
    return _sure_pieces(rows.filter("NOT apart"), ranks, chunk).unionByName(
        _in_order(rows.filter("apart"), ranks, pattern, chunk)
    )


def _parts(documents: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Ids of texts of one chunk, and of longer ones."""
    if not LOOK < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk and longer than what patterns look ahead")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    return (_whole(documents.filter(~long), ranks, pattern),
            _long(documents.filter(long), ranks, pattern, chunk, overlap))


def encode(documents: DataFrame, ranks: str | None = None, pattern: str | None = None,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, tag, part, ids, whole``: a row per document, or several of a long text.

    Rows of one long text share ``tag`` and follow one another by ``part``; ``whole`` marks texts of one row.
    """
    short, long = _parts(documents, ranks or default_ranks(), pattern or default_pattern(), chunk, overlap)
    return short.withColumn("whole", F.lit(True)).unionByName(long.withColumn("whole", F.lit(False)))


def _of_tokens(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many ids."""
    for batch in batches:
        size = np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(int(np.searchsorted(size, before + most, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """The rows with ``data``, the bytes of their ids."""
    ranks = ranks or default_ranks()
    names = encoded.columns
    schema = encoded.withColumn("data", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(Ranks.of(ranks))
        for batch in _of_tokens(batches, 1 << 19):
            lists = batch.column("ids")
            data, ends = tokens.decode(lists.flatten().to_numpy())
            rows = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            offsets = np.concatenate([[0], np.append(0, ends)[rows]]).astype(np.int32)
            texts = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, "data"])

    return common.arrow_map(encoded, run, schema)


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digest_rows(rows: DataFrame) -> DataFrame:
    """Digests of rows in order: rows of one ``tag`` and document follow one another; state of constant size."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in _of_tokens(batches, 1 << 19):
            out = []
            for doc_id, tag, ids, data in zip(
                *[batch.column(c).to_pylist() for c in ("doc_id", "tag", "ids", "data")], strict=True
            ):
                if key != tag:
                    if key is not None:
                        out.append((last, n, texts.hexdigest(), whole.hexdigest()))
                    key, last, n, texts, whole = tag, doc_id, 0, hashlib.sha256(), hashlib.sha256()
                if ids:
                    texts.update(((" " if n else "") + " ".join(map(str, ids))).encode())
                whole.update(data)
                n += len(ids)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": last, "n_tokens": n, "ids_sha256": texts.hexdigest(),
                                               "decoded_sha256": whole.hexdigest()}], schema)

    return common.arrow_map(
        rows.repartition("tag").sortWithinPartitions("tag", "part").select("doc_id", "tag", "ids", "data"), run, RESULT)


def digests(documents: DataFrame, ranks: str | None = None, pattern: str | None = None,
            chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again."""
    ranks = ranks or default_ranks()
    # Each part is decoded by itself, so that neither is encoded for the other's digests.
    whole, parts = _parts(documents, ranks, pattern or default_pattern(), chunk, overlap)
    short = decode(whole, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
    return short.unionByName(_digest_rows(decode(parts, ranks)))
