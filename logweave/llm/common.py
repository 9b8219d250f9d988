"""What the operators share: the scratch folder, written tables, words and their hashes."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import logweave

#: A word: what stands between these characters (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors and the driver reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, computed once and read again: cuts the lineage and survives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Spark's own bounded Bloom filter (8 MB at most) of a join's small side, tested where the large side is read;
#: by default Spark asks for 10 GB of the large side before it takes the trouble.
PRUNE = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    # Tables of wanted keys grow with the documents: one way to join for every size.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def written_matches(rows: DataFrame, wanted: DataFrame, on: list[str], name: str) -> DataFrame:
    """The join of rows with long texts and a written table of wanted keys, computed once.

    Rows whose first key a Bloom filter rules out are not shuffled; what it lets through by mistake, the join drops.
    """
    spark = rows.sparkSession
    before = {key: spark.conf.get(key, None) for key in PRUNE}
    for key, value in PRUNE.items():
        spark.conf.set(key, value)
    try:
        # The comparison tells the optimiser that the wanted side is selective.
        picked = wanted.filter(F.col(on[0]) >= F.lit(-(1 << 63)))
        return written(rows.join(picked, on), name)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A store that this process reaches, by the path's scheme, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(logweave.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    folder = shared_folder(spark, "package")
    where, name = place(folder)
    where.create_dir(name, recursive=True)
    with where.open_output_stream(f"{name}/logweave.zip") as out:
        out.write(packed.getvalue())
    context.addPyFile(f"{folder}/logweave.zip")
    _SHIPPED.add(context.applicationId)


def arrow_map(frame: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship(frame.sparkSession)
    return frame.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: Sequence[str]) -> str:
    """A name that none of the columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def as_binary(text: Column) -> Column:
    """UTF-8 bytes; Python splits those at exactly the gaps above."""
    return F.coalesce(text, F.lit("")).cast("binary")


class WordIds(dict):
    """64-bit hash of each word, remembered; ``bound()`` between batches keeps it small."""

    def __init__(self, most: int = 1 << 19):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def bound(self) -> None:
        if len(self) > self.most:
            self.clear()


def word_hashes(texts: Sequence[bytes], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and where each text's words begin."""
    ids.bound()
    lists = [t.split() for t in texts]
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(w) for w in lists], out=ends[1:])
    words = chain.from_iterable(lists)
    flat = np.fromiter(map(ids.__getitem__, words), np.uint64, int(ends[-1]))
    return flat, ends


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text, so that long texts stay bounded."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        size = np.cumsum(length.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = int(np.searchsorted(size, before + most_bytes, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over all output bits (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(flat: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every ``width`` neighbours, as they stand in ``flat``.

    Computed by doubling: the hash of a window is that of its left part times a power of
    the base plus that of its right part.  Windows that cross the border of two texts are the caller's to leave out.
    """
    n = len(flat) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = {1: base}
    level, have, spans = flat, 1, {1: flat}
    while have * 2 <= width:
        m = len(level) - have
        level = level[:m] * np.uint64(power[have]) + level[have:]
        power[have * 2] = pow(power[have], 2, 1 << 64)
        have *= 2
        spans[have] = level
    out = spans[have][:n].copy()
    at = have
    for part in sorted(spans, reverse=True):
        if width - at >= part:
            out = out * np.uint64(power[part]) + spans[part][at : at + n]
            at += part
    return mix(out)
