"""Token ids in files of independent Zstandard frames.

A shard is one file: a frame for each document, a skippable frame with the documents' ids, and at the end a
skippable frame with the seek table (sizes and a checksum of every frame, as in the public seekable
format).  Any Zstandard decoder reads the whole file; a reader that knows the seek table opens only the
frames of the documents it wants, and checks each one.

Shards hold ranges of ``doc_id`` in ascending order.  A task writes its shard beside the final name and then
renames it, so a task that runs again replaces its own file and a lost one leaves none that counts: the
manifest (a row per shard) names the files.

* Documents are ordered by id, then text; null ids come first; repeated rows are written as often as they occur.
* Null texts count as empty; each document ends with ``end_id``, so an empty one has one id.
* An empty table gives no shard with documents; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm import common

#: Fixed values of the seekable format: magic numbers of skippable frames and of the footer.
DIRECTORY_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
SKIPPABLE = struct.Struct("<II")
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
HEADER = struct.Struct("<BBIQ")  # version, bytes of an id, end id, documents

#: Tasks that read shards back; beyond it a task reads several.
MOST_TASKS = 100_000

MANIFEST = ("shard int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint, "
            "first_id bigint, last_id bigint")


# ---- encoding -------------------------------------------------------------------


def byte_letters() -> set[str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in plain} | {chr(256 + k) for k in range(256 - len(plain))}


class Memory:
    """Ids of short strings, as two columns; when they are full, only strings that were met again stay."""

    #: Longer strings, in bytes, are not worth remembering.
    SHORT = 64

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.strings, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.met = np.zeros(0, bool)

    def bound(self) -> None:
        """Between batches, as places change."""
        if len(self.strings) > self.most:
            met = pa.array(self.met)
            self.strings, self.ids = self.strings.filter(met), self.ids.filter(met)
            self.met = np.zeros(len(self.strings), bool)
            if len(self.strings) > self.most // 2:
                self.clear()

    def find(self, strings: pa.Array) -> pa.Array:
        """Where they stand, null if they are new."""
        at = pc.index_in(strings, value_set=self.strings)
        self.met[at.drop_null().to_numpy()] = True
        return at

    def add(self, strings: pa.Array, ids: pa.Array) -> None:
        short = pc.less_equal(pc.binary_length(strings), self.SHORT)
        self.strings = pa.concat_arrays([self.strings, strings.filter(short)])
        self.ids = pa.concat_arrays([self.ids, ids.filter(short)])
        self.met = np.append(self.met, np.zeros(len(self.strings) - len(self.met), bool))


class Encoder:
    """Ids of texts by a tokenizer file, with the ids of frequent words remembered.

    A byte-level pre-tokenizer never joins characters across a space that begins a word, nor across the
    end of a run of letters before other ASCII, so a text's ids are those of such pieces one after the other.
    Each word of a batch is looked for once.  Runs of letters go to the merges directly, many new ones in a call.
    Other kinds of tokenizer get the whole text.
    """

    #: A space before a character that is certainly no white space; any other space.
    CUT = re.compile(" (?=[!-~¡-ɏ])")
    ODD = " ([^!-~¡-ɏ]|$)"
    RUN = "^[A-Za-zÀ-ÖØ-öø-ɏ]+$"
    #: Letters, and what follows them in ASCII.
    CORE = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-@\\[-`{-~].*)?", re.DOTALL)
    #: Two words with one line end between them, which is then a piece of its own.
    LINES = re.compile("(\\S+)(\\n)([!-~¡-ɏ]\\S*)")
    #: Runs of letters in a call.
    RUNS = 10_000

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        before, model = rules.get("pre_tokenizer") or {}, rules["model"]
        self.by_piece = (
            model.get("type", "BPE") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                               "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and model["vocab"].keys() >= byte_letters()
            and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not rules.get("normalizer")
            and not rules.get("post_processor")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]
                        or re.match("[A-Za-zÀ-ɏ]", t["content"]) for t in rules.get("added_tokens", []))
        )
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        #: Words with a space before them; strings that follow something else, of which there are few.
        self.most, self.words, self.parts = most, Memory(most), {}
        if self.by_piece:
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self.merges = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
            self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            #: Bytes of each id.
            self.bytes = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            for token, k in model["vocab"].items():
                self.bytes[k] = len(token)

    @classmethod
    @lru_cache(maxsize=2)
    def of(cls, path: str) -> Encoder:
        """The same for all tasks of a worker process, with the words it remembers."""
        return cls(path)

    def _ids(self, texts: list[str]) -> list[bytes]:
        # One by one: in a batch the library takes threads of other tasks, and holds its large objects of all texts.
        encode, kind = self.tokenizer.encode_batch_fast, f"<u{self.width}"
        return [np.array(encode([t], add_special_tokens=False)[0].ids, kind).tobytes() for t in texts]

    def _runs(self, runs: list[str]) -> pa.Array:
        """Ids of runs of letters (after a space or not), each of which is one pre-token."""
        out = [pa.array([], pa.large_binary())]
        for k in range(0, len(runs), self.RUNS):
            some = runs[k : k + self.RUNS]
            found = self.merges.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found[0].ids, f"<u{self.width}")
            # The last id of a run ends with its last byte.
            ends = np.cumsum(pc.binary_length(pa.array(some)).to_numpy().astype(np.int64))
            edges = np.append(0, self.width * (np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1))
            out.append(pa.Array.from_buffers(
                pa.large_binary(), len(some), [None, pa.py_buffer(edges), pa.py_buffer(ids.tobytes())]))
        return pa.concat_arrays(out)

    def _new(self, strings: pa.Array, space: str) -> pa.Array:
        """Ids of strings with ``space`` before them."""
        other = pc.invert(pc.match_substring_regex(strings, self.RUN))
        runs, others = [[space + s for s in _objects(strings.filter(m))] for m in (pc.invert(other), other)]
        ids = pa.concat_arrays([self._runs(runs), pa.array(self._ids(others), pa.large_binary())])
        return ids.take(_places(other))

    def _split(self, piece: str) -> list[str]:
        """The strings whose ids, one after the other, are the piece's: letters and what follows them."""
        core = self.CORE.fullmatch(piece)
        if core and (core[2] is None or "\n" not in core[2]):
            return [core[1], core[2]] if core[2] else [piece]
        lines = self.LINES.fullmatch(piece)
        if lines:
            return [*self._split(lines[1]), "\n", *self._split(lines[3])]
        return [piece]

    def _parts(self, strings: set[str]) -> dict[str, bytes]:
        """Ids of strings without a space before them, remembered."""
        if len(self.parts) > self.most // 4 or sum(map(len, self.parts)) > 4 * self.most:  # heads may be long
            self.parts = {}
        new = [s for s in strings if s not in self.parts]
        self.parts.update(zip(new, _objects(self._new(pa.array(new, pa.string()), "")), strict=True))
        return self.parts

    def _learn(self, pieces: list[str], heads: list[str]) -> tuple[pa.Array, list[bytes]]:
        """Ids of new pieces, which stand after a space and are remembered, and of heads, which don't and are not."""
        more = np.zeros(len(pieces), bool)
        first, after = [], []
        for k, piece in enumerate(pieces):
            if piece.isascii() and piece.isalpha():
                continue
            word, *parts = self._split(piece)
            if parts:
                more[k] = True
                first.append(word)
                after.append(parts)
        split = [self._split(h) for h in heads]
        parts = self._parts(set().union(*after, *split))

        # Words may be known without what follows them here.
        pieces, more = pa.array(pieces, pa.string()), pa.array(more)
        whole = pieces.filter(pc.invert(more))
        words = pa.concat_arrays([whole, pa.array(first, pa.string())]).dictionary_encode()
        at = self.words.find(words.dictionary)
        new = words.dictionary.filter(pc.is_null(at))
        ids = self._new(new, " ")
        of_words = _filled(self.words.ids, at, ids).take(words.indices)
        rest = pa.array([b"".join([parts[s] for s in p]) for p in after], pa.large_binary())
        joined = pc.binary_join_element_wise(of_words[len(whole):], rest, pa.scalar(b"", pa.large_binary()))
        self.words.add(new, ids)
        self.words.add(pieces.filter(more), joined)
        found = pa.concat_arrays([of_words[: len(whole)], joined]).take(_places(more))
        return found, [b"".join([parts[s] for s in p]) for p in split]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._ids(_objects(texts) if isinstance(texts, pa.Array) else texts)
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, self.ODD)
        rows = pa.concat_arrays([
            pc.split_pattern(texts.filter(pc.invert(odd)), " "),
            pa.array([self.CUT.split(t) for t in _objects(texts.filter(odd))], pa.list_(pa.string())),
        ])
        ends = np.cumsum(rows.value_lengths().to_numpy().astype(np.int64))
        starts = np.append(0, ends[:-1])
        pieces = rows.flatten()
        heads = _objects(pieces.take(pa.array(starts)))
        after = np.ones(len(pieces), bool)
        after[starts] = False
        # A column with a number for each distinct word, null for heads.
        coded = pc.if_else(pa.array(after), pieces, None).dictionary_encode()
        self.words.bound()
        at, before = self.words.find(coded.dictionary), self.words.ids
        new, of_heads = self._learn(_objects(coded.dictionary.filter(pc.is_null(at))), heads)
        ids = pa.concat_arrays([_filled(before, at, new), pa.array(of_heads, pa.large_binary())])
        which = pc.fill_null(coded.indices, 0).to_numpy().copy()
        which[starts] = len(at) + np.arange(len(heads))
        found = ids.take(pa.array(which))
        edges = np.frombuffer(found.buffers()[1], np.int64)
        data = memoryview(found.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(edges[starts].tolist(), edges[ends].tolist(), strict=True)]
        return [out[k] for k in _places(odd).to_pylist()]


def _gathered(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many bytes, but the last: each goes through all remembered words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _objects(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _places(last: pa.Array) -> pa.Array:
    """Where each row stands when the marked ones follow the others."""
    return pa.array(np.argsort(np.argsort(last.to_numpy(zero_copy_only=False), kind="stable")))


def _filled(ids: pa.Array, at: pa.Array, new: pa.Array) -> pa.Array:
    """Ids by place; nulls take the new ones in order."""
    places = pc.replace_with_mask(at, pc.is_null(at), pa.array(np.arange(len(ids), len(ids) + len(new)), at.type))
    return pa.concat_arrays([ids, new]).take(places)


# ---- files ----------------------------------------------------------------------


class ShardWriter:
    """Frames in the order they are added; ``close`` writes the directory and the seek table."""

    def __init__(self, path: str, width: int, end_id: int, level: int = 3):
        self.fs, self.final = common.place(path)
        self.part = f"{self.final}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.fs.create_dir(self.final.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.width, self.end_id = width, end_id
        self.ids: list[int | None] = []
        self.entries: list[tuple[int, int, int]] = []
        self.bytes = self.tokens = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        packed = self.pack(data)
        if max(len(packed), len(data)) >> 32:
            raise ValueError(f"document {doc_id} is too long for one frame")
        self.out.write(packed)
        self.ids.append(doc_id)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.bytes += len(packed)
        self.tokens += len(data) // self.width

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], bool)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        directory = (HEADER.pack(1, self.width, self.end_id, len(ids)) + ids.tobytes()
                     + np.packbits(known).tobytes())
        self.out.write(SKIPPABLE.pack(DIRECTORY_MAGIC, len(directory)) + directory)
        table = np.array(self.entries, ENTRY).tobytes()
        table += FOOTER.pack(len(self.entries), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(SKIPPABLE.pack(SEEK_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.part, self.final)


class ShardReader:
    """Reads the seek table and the ids; then only the frames that are asked for."""

    def __init__(self, path: str):
        where, name = common.place(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        frames, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{path} has no seek table")
        length = frames * ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(length, size - FOOTER.size - length), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        at = int(self.starts[-1])
        magic, length = SKIPPABLE.unpack(self.file.read_at(SKIPPABLE.size, at))
        directory = self.file.read_at(length, at + SKIPPABLE.size)
        _, self.width, self.end_id, count = HEADER.unpack_from(directory)
        if magic != DIRECTORY_MAGIC or count != frames:
            raise ValueError(f"{path} has no directory of its documents")
        self.ids = np.frombuffer(directory, "<i8", count, HEADER.size)
        bits = np.frombuffer(directory, np.uint8, offset=HEADER.size + 8 * count)
        self.known = np.unpackbits(bits, count=count).astype(bool) if count else np.zeros(0, bool)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the document in frame ``k``."""
        data = self.unpack(self.file.read_at(int(self.entries["packed"][k]), int(self.starts[k])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, f"<u{self.width}")

    def offsets(self) -> np.ndarray:
        """Ids in the shard before each document, known from the seek table alone."""
        return np.concatenate([[0], np.cumsum(self.entries["size"].astype(np.int64) // self.width)])

    def find(self, doc_ids) -> np.ndarray:
        """Frames of the documents with these ids."""
        return np.flatnonzero(self.known & np.isin(self.ids, np.asarray(doc_ids, np.int64)))


# ---- jobs -----------------------------------------------------------------------


def write_tokens(
    documents: DataFrame, tokenizer: str, folder: str, end_id: int = 0, batch_bytes: int = 8 << 20
) -> DataFrame:
    """Writes the shards; returns the manifest with ``start``, the ids in all shards before each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.tok"
        out = None
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        for batch in _gathered(common.slices(batches, batch_bytes, "text"), batch_bytes // 2):
            out = out or ShardWriter(path, encoder.width, end_id)
            encoded = encoder.encode(batch.column("text"))
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                out.add(doc_id, data + end)
        if out:
            out.close()
            ids = [i for i in out.ids if i is not None] or [None]
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "path": path, "n_docs": len(out.ids), "n_tokens": out.tokens,
                "n_bytes": out.bytes, "first_id": ids[0], "last_id": ids[-1],
            }], pa.schema([("shard", pa.int32()), ("path", pa.string()), *[
                (c, pa.int64()) for c in ("n_docs", "n_tokens", "n_bytes", "first_id", "last_id")]]))

    ordered = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    manifest = common.written(ordered.transform(common.arrow_map, write, MANIFEST), "token-manifest")
    # A row per shard, not per document.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, doc_ids: list[int] | None = None, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ``ids``) from the files.

    ``doc_ids``, a stated list, opens only the shards whose range can hold one and only those frames.
    """
    wanted = manifest
    if doc_ids is not None:
        met = F.lit(False)
        for i in doc_ids:
            met = met | F.lit(i).between(F.col("first_id"), F.col("last_id"))
        wanted = manifest.filter(met)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * ids
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["path"])
                offsets = shard.offsets()
                frames = range(len(shard.ids)) if doc_ids is None else shard.find(doc_ids)
                rows, held = [], 0
                for k in frames:
                    tokens = shard.tokens(k)
                    out = [int(shard.ids[k]) if shard.known[k] else None, row["start"] + int(offsets[k]),
                           len(tokens), zlib.crc32(tokens.astype("<u4").tobytes())]
                    rows.append(out + [tokens.astype(np.int64)] * ids)
                    held += len(tokens) * ids + 16
                    if held > 1 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                yield _batch(rows, schema)

    # A shard is a task's work; Spark keeps a stated number of partitions.
    tasks = min(max(wanted.count(), 1), MOST_TASKS)
    return wanted.repartitionByRange(tasks, "shard").transform(common.arrow_map,
        read, ", ".join(f"{n} {'array<bigint>' if n == 'ids' else 'bigint'}" for n in names)
    )


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(documents: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes all documents and reads them back."""
    spark: SparkSession = documents.sparkSession
    folder = folder or common.shared_folder(spark, "tokens")
    return read_tokens(write_tokens(documents, tokenizer or default_tokenizer(), folder))
