"""Near-duplicates by SetSketch registers.

A document is the set of its 5-word shingles, hashed to 64 bits.  Its sketch has ``BANDS * ROWS`` registers: for each
one the smallest of as many exponential variables as the set has members, truncated to an
exponential scale.  Registers of parts merge by maximum, and equal registers are as likely as the sets are similar, so
bands of registers find candidates; the similarity of a candidate pair is estimated from all
registers jointly by maximum likelihood, and what isn't ruled out by that is verified on the full sets.

Equal sets are one node.  In each bucket every node is compared with the first one only, and the links that
hold are joined to components.  Buckets whose members are then all in one component are done.  In the others
all nodes of different components are compared on their full sets, inside of a task and in blocks; only links that join
components leave the task.  So no link between components is lost, no bucket is capped, and pairs within a bucket are never listed.

* Words are lower-cased (A-Z) and split at ``[\\x20\\x09-\\x0D]+``.  With fewer words than a shingle, the whole
  sequence is the one shingle; without words (or with a null text) the set is empty and linked with nothing.
* A null id counts as larger than all others.  Rows that share an id and a text are one node.  Rows that share an id but not the text are
  nodes of their own.
* Of a group the smallest id is kept (with repeated ids, also the smallest hash of the text).
* An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common
from logweave.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Base of the exponential scale and rate of the variables, as usual for 16-bit registers.
SCALE_BASE, RATE = 1.001, 20.0
#: How far an estimate may be below the threshold before a pair is ruled out: seven standard deviations.
MARGIN = 0.2
BLOCK = 512
NO_ID = (1 << 63) - 1


# ---- sets and sketches --------------------------------------------------------


def shingles(flat: np.ndarray, ends: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes = common.rolling(flat, width)
    out = []
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if end - begin >= width:
            out.append(np.unique(hashes[begin : end - width + 1]))
        elif end > begin:
            # Shorter sequences get their length mixed in, so that they equal no full shingle.
            whole = common.rolling(flat[begin:end], end - begin) + np.uint64(end - begin)
            out.append(common.mix(whole))
        else:
            out.append(np.empty(0, np.uint64))
    return out


_SEEDS = np.random.default_rng(20).integers(0, 1 << 63, (2, REGISTERS), np.uint64)
_TIMES, _PLUS = (_SEEDS[0] * np.uint64(2) + np.uint64(1))[:, None], _SEEDS[1][:, None]


def sketch(members: np.ndarray) -> np.ndarray:
    """Registers of a set; empty sets have zeros."""
    if not len(members):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(members), 256):
        values = members[None, k : k + 256] * _TIMES
        values ^= _PLUS
        values ^= values >> np.uint64(31)
        values *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(low, values.min(axis=1), out=low)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(SCALE_BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs by maximum likelihood, given the registers and the sizes of both sets.

    The chance that one register is larger depends on the similarity; the likelihood has one peak, found by golden section.
    """
    more, less = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    same = a.shape[-1] - more - less
    u = n_a / np.maximum(n_a + n_b, 1)
    v = 1 - u

    def chance(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (SCALE_BASE - 1) / SCALE_BASE) / np.log(SCALE_BASE)

    def value(j):
        up, down = chance(u - v * j), chance(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros_like(u), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    ratio = (5**0.5 - 1) / 2
    for _ in range(30):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = value(left) > value(right)
        high, low = np.where(better, right, high), np.where(better, low, left)
    return (low + high) / 2


SKETCHES = "doc_id bigint, tag bigint, n bigint, set_a bigint, set_b bigint, registers binary"


def sketches(rows: DataFrame) -> DataFrame:
    """A row per document: size, two order-free hashes of the set, and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = common.WordIds()
        for batch in common.slices(batches, 2 << 20, "words"):
            texts = [t.lower() for t in batch.column("words").to_pylist()]
            sets = shingles(*common.word_hashes(texts, ids))
            sums = [[np.sum(s).view(np.int64), np.bitwise_xor.reduce(common.mix(s)).view(np.int64)] for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("tag"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int(a) for a, _ in sums], pa.int64()), pa.array([int(b) for _, b in sums], pa.int64()),
                pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
            ], names=["doc_id", "tag", "n", "set_a", "set_b", "registers"])

    return common.arrow_map(rows.select("doc_id", "tag", "words"), run, SKETCHES)


def full_sets(rows: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = common.WordIds()
        for batch in common.slices(batches, 1 << 20, "words"):
            texts = [t.lower() for t in batch.column("words").to_pylist()]
            sets = shingles(*common.word_hashes(texts, ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"]
            )

    return common.arrow_map(rows.select("node", "words"), run, "node bigint, members binary")


# ---- candidates and links ------------------------------------------------------


def buckets(nodes: DataFrame) -> DataFrame:
    """node and the key of each of its bands."""
    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(k), F.substring("registers", k * width + 1, width)) for k in range(BANDS)]
    return nodes.filter("n > 0").select("node", F.explode(F.array(*keys)).alias("key"))


def estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that sizes and registers don't rule out."""
    side = lambda c: nodes.select(
        F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")
    )
    rows = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .filter(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_registers(batch.column(c).to_pylist()) for c in ("r_a", "r_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = likely(a, b, n_a, n_b) >= threshold - MARGIN
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(keep))

    return common.arrow_map(rows, run, "a bigint, b bigint")


def _registers(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), REGISTERS)


def sets_of(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node and members of the wanted nodes, computed once."""
    wanted = common.written(wanted.join(nodes.select("node", "doc_id", "tag"), "node"), "near-wanted")
    texts = common.written_matches(rows, wanted, ["doc_id", "tag"], "near-texts")
    # Rows that repeat an id and a text give their node's set more than once.
    return common.written(full_sets(texts).dropDuplicates(["node"]), "near-sets")


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full sets.

    Each node's set is that of its first document; only the texts of nodes in pairs move.
    """
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, rows)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"s_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 8 << 20, "s_a"):
            keep = []
            for a, b in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common_n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common_n >= percent * (len(both) - common_n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return common.arrow_map(joined, run, "a bigint, b bigint")


def open_buckets(found: DataFrame, roots: DataFrame) -> DataFrame:
    """node, key, root and block of the buckets with three nodes or more of different components.

    Bands often hold the same nodes; of equal buckets (their size and two sums of 64-bit hashes) only one is kept.
    """
    rooted = found.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = common.written(rooted, "near-rooted")
    mixed = (
        rooted.groupBy("key").agg(
            F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"),
            *[F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(20,0)")).alias(f"print_{k}") for k in (1, 2)],
        )
        .filter("size > 2 and low < high")
        .groupBy("size", "print_1", "print_2").agg(F.min("key").alias("key"))
    )
    return rooted.join(mixed, "key").select(
        "key", "node", "root", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    )


#: Columns of one dense slice of a group's incidence matrix.
SLICE = 8192


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components, on full sets: enough of them to join all that are linked.

    A bucket's nodes are dealt into blocks; each pair of blocks is a group of at most ``2 * BLOCK`` nodes.  Its
    intersections are one product of the incidence matrix of the shingles that two nodes of the group share at least,
    in slices.  No pair leaves the task but for the links that join two components of the group.
    """
    dealt = members.join(sets, "node").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "root", "members",
    )

    def compare(key, table):
        node, root, block = (table.column(c).to_numpy() for c in ("node", "root", "block"))
        held = [np.frombuffer(m, np.uint64) for m in table.column("members").to_pylist()]
        size = np.array([len(m) for m in held], np.float64)
        owner = np.repeat(np.arange(len(held)), size.astype(np.int64))
        _, place, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        shared = count[place] > 1
        owner, column = owner[shared], number[place[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        left, right = (np.flatnonzero(block == key[k].as_py()) for k in (1, 2))
        both = np.zeros((len(left), len(right)), np.float64)
        for low in range(0, int(number[-1]) + 1, SLICE):
            k = slice(*np.searchsorted(column, [low, low + SLICE]))
            dense = np.zeros((len(held), SLICE), np.float32)
            dense[owner[k], column[k] - low] = 1
            both += dense[left] @ dense[right].T
        union = size[left][:, None] + size[right] - both
        linked = (100 * both >= percent * union) & (root[left][:, None] != root[right])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out_a, out_b = [], []
        for x, y in zip(*[v.tolist() for v in np.nonzero(linked)], strict=True):
            p, q = find(int(root[left[x]])), find(int(root[right[y]]))
            if p != q:
                parent[p] = q
                out_a.append(int(node[left[x]]))
                out_b.append(int(node[right[y]]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    common.ship(members.sparkSession)
    return spread.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def find_roots(nodes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """node and the root of its component, for all nodes that have a link."""
    threshold = percent / 100
    found = buckets(nodes)
    leads = found.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size"))
    pairs = (
        found.join(leads.filter("size > 1"), "key").filter("node <> lead")
        .select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    )
    likely_pairs = common.written(
        estimated(common.written(pairs, "near-pairs"), nodes, threshold), "near-likely"
    )
    links = common.written(verified(likely_pairs, nodes, rows, percent), "near-links")
    roots = components(links)
    members = common.written(open_buckets(found, roots), "near-open")
    if members.isEmpty():
        return roots
    sets = sets_of(members.select("node").distinct(), nodes, rows)
    more = common.written(across(members, sets, percent), "near-links")
    return roots if more.isEmpty() else components(links.unionByName(more))


def near_dedup(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, tag, n_shingles, component_id, kept of every row."""
    rows = documents.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tag"),
        common.as_binary(F.col("text")).alias("words"),
    )
    found = common.written(sketches(rows), "near-sketches")
    of_set = ["n", "set_a", "set_b"]
    # One node for equal sets; its number is a hash of the set, so ids may repeat.
    node = F.xxhash64(*of_set).alias("node")
    # Equal sets have equal registers.
    nodes = common.written(
        found.filter("n > 0").groupBy(node, "n").agg(
            F.min(F.struct("doc_id", "tag")).alias("first"), F.first("registers").alias("registers")
        ).select("node", "n", "first.doc_id", "first.tag", "registers"),
        "near-nodes",
    )
    roots = find_roots(nodes, rows, percent)
    named = found.select("doc_id", "tag", "n", node).join(roots, "node", "left").select(
        "doc_id", "tag", "n", F.coalesce("root", "node").alias("root")
    )
    lowest = named.filter("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("lowest"))
    joined = named.join(lowest, "root", "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("lowest.doc_id"))
    return joined.select(
        _shown(F.col("doc_id")).alias("doc_id"), "tag", F.col("n").alias("n_shingles"),
        _shown(component).alias("component_id"),
        (alone | (F.struct("doc_id", "tag") == F.col("lowest"))).alias("kept"),
    )


def _shown(doc_id):
    return F.when(doc_id != NO_ID, doc_id)


def keep_first(documents: DataFrame, percent: int = 85) -> DataFrame:
    """The documents with one row of each group, and all without words; with their own columns."""
    judged = common.written(near_dedup(documents, percent), "near-judged")
    gone_id, gone_tag = (common.fresh(n, documents.columns) for n in ("gone_id", "gone_tag"))
    dropped = judged.filter(~F.col("kept")).select(
        F.col("doc_id").alias(gone_id), F.col("tag").alias(gone_tag)
    ).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_tag))
    left = documents.join(dropped.hint("merge"), same, "left_anti")
    again = judged.filter("kept and n_shingles > 0").groupBy("doc_id", "tag").count().filter("count > 1")
    if again.isEmpty():
        return left
    # Rows that repeat both id and text are one document.
    words = F.coalesce(F.col("text"), F.lit("")).rlike(common.WORD)
    return left.filter(words).dropDuplicates(["doc_id", "text"]).unionByName(left.filter(~words))
