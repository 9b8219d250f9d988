"""Ranked lexical search by the Best Position Algorithm.

Documents are indexed in shards: the rows that one task reads, up to ``SHARD`` postings at a time.  A shard has an impact
list for each term (its postings by falling impact) and the same postings by document for direct access.  A
search reads the lists of an item's terms from the top, a block of positions of each at a time; every document
met is scored in full by direct accesses, which also mark its positions in the other lists.  A list's best position
is the last one before the first gap among those seen; the weighted impacts there bound the score of every document not met
yet.  The search stops once that bound is strictly below the k-th score, so documents that tie are all met.  The shards'
best ``top`` documents of an item are merged into the item's.

No posting is shuffled.  Weights of the terms go to a table in the shared folder, which the tasks read in blocks; only the
number of documents and of terms goes through the driver.  Each shard looks at every item, a stated query set.

* Null texts hold no term; documents without one are not counted and never found.  Null ids rank after all others.
* Rows with equal ids are documents of their own; each row of the items is a search of its own.
* Items without a term, or none that stands in a document, find nothing; empty tables give an empty result.
* Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common

#: Separators of terms are all of ASCII but digits and letters; A-Z are lower-cased, all else stays.
BREAKS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)).lower()
#: Postings of one shard, and terms that a task keeps to leave out others while it reads documents.
SHARD, WANTED = 4_000_000, 500_000
#: Items that a task holds at a time.
ITEMS = 4_096
#: Fixed values of the score: tf * 10**9 div (1000 * tf + 12 * m), m = 75 + 25 * n * N div L.
UNIT, GAIN, DAMP, BASE, LENGTH = 1_000_000_000, 1_000, 12, 75, 25
#: A null id's place after all others.
LAST = (1 << 63) - 1


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(BREAKS).split() if text else []


# ---- tables ---------------------------------------------------------------------

POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.binary())),
                      ("tf", pa.list_(pa.int64()))])
POSTINGS_TYPE = "doc_id bigint, n bigint, terms array<binary>, tf array<bigint>"


def read_blocks(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """A written table in blocks, without Spark: for tasks."""
    where, name = common.place(path)
    for info in where.get_file_info(fs.FileSelector(name)):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(rows, columns=columns)


def _postings(documents: DataFrame, vocabulary: str | None) -> DataFrame:
    """A row per document: its number of terms, and its terms with their counts.

    With a vocabulary (a written table) only those terms: that leaves out what no search asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None
        if vocabulary is not None:
            wanted = {t for b in read_blocks(vocabulary, ["term"], 1 << 16) for t in b.column("term").to_pylist()}
        for batch in common.slices(batches, 8 << 20, "text"):
            sizes, found, ends = [], [], [0]
            counts = []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                sizes.append(len(words))
                tf = Counter(words if wanted is None else filter(wanted.__contains__, words))
                found += tf.keys()
                counts += tf.values()
                ends.append(len(found))
            cuts = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(cuts, pa.array(found, pa.binary())),
                pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int64())),
            ], schema=POSTINGS)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.as_binary(F.col("text")).alias("text"))
    return common.arrow_map(rows, run, POSTINGS_TYPE)


def _item_terms(items: DataFrame) -> DataFrame:
    """item (its row's number), item_id, term, and how often the item has it."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("term", pa.binary()), ("q", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (item, item_id, term, q)
                for item, item_id, text in zip(*[batch.column(c).to_pylist() for c in ("item", "item_id", "text")],
                                               strict=True)
                for term, q in Counter(terms(text)).items()
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)],
                schema=schema)

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"),
                        common.as_binary(F.col("text")).alias("text"))
    return common.arrow_map(rows, run, "item bigint, item_id bigint, term binary, q bigint")


# ---- one shard ------------------------------------------------------------------


class Shard:
    """Impact lists of some documents, and direct access to them."""

    def __init__(self, doc_ids: np.ndarray, sizes: np.ndarray, count: np.ndarray, codes: np.ndarray, tf: np.ndarray,
                 names: list[bytes], n_documents: int, n_terms: int):
        self.doc_ids = doc_ids
        doc = np.repeat(np.arange(len(doc_ids)), count)
        m = BASE + (LENGTH * sizes * n_documents) // n_terms
        impact = (UNIT * tf) // (GAIN * tf + DAMP * m[doc])
        by_doc = np.lexsort((doc, codes))
        self.docs, self.impacts = doc[by_doc], impact[by_doc]
        ends = np.searchsorted(codes[by_doc], np.arange(len(names) + 1))
        self.place = {name: (int(ends[k]), int(ends[k + 1])) for k, name in enumerate(names)}
        # Within each term's stretch: the postings by falling impact, and each posting's position among them.
        self.falling = np.lexsort((doc[by_doc], -impact[by_doc], codes[by_doc]))
        self.position = np.empty(len(doc), np.int64)
        self.position[self.falling] = np.arange(len(doc))

    def search(self, query: list[tuple[bytes, int]], top: int, step: int = 64) -> list[tuple[int, int]]:
        """(score, document's number) of the ``top`` best, unordered; equal scores by id."""
        lists = [(*self.place[t], g) for t, g in query if t in self.place and g > 0]
        if not lists:
            return []
        met = np.zeros(len(self.doc_ids), bool)
        seen = [np.zeros(stop - start, bool) for start, stop, _ in lists]
        best = [0] * len(lists)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth = 0
        while True:
            new = np.concatenate([
                self.docs[self.falling[start + depth : min(start + depth + step, stop)]] for start, stop, _ in lists])
            new = np.unique(new[~met[new]])
            met[new] = True
            score = np.zeros(len(new), np.int64)
            bound = 0
            for k, (start, stop, g) in enumerate(lists):
                own = self.docs[start:stop]
                at = np.searchsorted(own, new)
                hit = at < stop - start
                hit[hit] = own[at[hit]] == new[hit]
                at = at[hit] + start
                score[hit] += g * self.impacts[at]
                seen[k][self.position[at] - start] = True
                gaps = seen[k][best[k] :]
                ahead = int(np.argmin(gaps)) if len(gaps) else 0
                best[k] = stop - start if not len(gaps) or gaps[ahead] else best[k] + ahead
                if best[k] < stop - start:  # at the end of a list no document of it is left
                    bound += g * int(self.impacts[self.falling[start + best[k] - 1]])
            docs, scores = self._keep(np.concatenate([docs, new]), np.concatenate([scores, score]), top)
            if bound == 0 or (len(scores) == top and bound < int(scores.min())):
                return list(zip(scores.tolist(), docs.tolist(), strict=True))
            depth += step
            step *= 2

    def _keep(self, docs: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        some = scores > 0
        docs, scores = docs[some], scores[some]
        order = np.lexsort((self.doc_ids[docs], -scores))[:top]
        return docs[order], scores[order]


HITS = "item bigint, item_id bigint, doc_id bigint, score bigint"


def _hits(postings: DataFrame, queries: str, n_documents: int, n_terms: int, top: int) -> DataFrame:
    """The best documents of each shard for each item."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column("tf").flatten())
            if size >= SHARD:
                yield build(held)
                held, size = [], 0
        if held:
            yield build(held)

    def build(held: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        words = pc.dictionary_encode(pc.list_flatten(table["terms"])).combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        count = pc.list_value_length(table["tf"]).to_numpy().astype(np.int64)
        return Shard(
            pc.fill_null(table["doc_id"], LAST).to_numpy(), table["n"].to_numpy(), count,
            words.indices.to_numpy().astype(np.int64), pc.list_flatten(table["tf"]).to_numpy(),
            words.dictionary.to_pylist(), n_documents, n_terms,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            for block in read_blocks(queries, ["item", "item_id", "terms", "weights"], ITEMS):
                rows = []
                for item, item_id, names, weights in zip(
                    *[block.column(c).to_pylist() for c in ("item", "item_id", "terms", "weights")], strict=True
                ):
                    for score, doc in shard.search(list(zip(names, weights, strict=True)), top):
                        i = int(shard.doc_ids[doc])
                        rows.append((item, item_id, None if i == LAST else i, score))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                        schema=schema)

    return common.arrow_map(postings, run, HITS)


# ---- the search -----------------------------------------------------------------


def search(documents: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents with a score above 0 of each item."""
    from pyspark.sql import Window

    spark = documents.sparkSession
    asked = common.written(_item_terms(items), "search-items")
    vocabulary = common.shared_folder(spark, "search-vocabulary")
    asked.select("term").distinct().write.parquet(vocabulary)
    wanted = spark.read.schema("term binary").parquet(vocabulary)
    # A larger vocabulary is not held by tasks; documents then keep all their terms.
    held = vocabulary if wanted.count() <= WANTED else None
    postings = common.written(_postings(documents, held), "search-postings")
    totals = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    n_documents, n_terms = totals["documents"], totals["terms"] or 0
    if not n_documents:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = (F.lit(2 * n_documents + 2).cast("double")) / (2 * F.col("df") + 1).cast("double")
    weighed = asked.join(df.join(wanted, "term", "left_semi"), "term").select(
        "item", "item_id", "term", (F.floor(1000 * F.log(ratio)) * F.col("q")).alias("weight"))
    queries = common.shared_folder(spark, "search-queries")
    weighed.groupBy("item", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select(
        "item", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")
    ).write.parquet(queries)
    # The best of each task first, then of all: Spark limits each item's rows on both sides of the shuffle.
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return _hits(postings.filter("size(tf) > 0"), queries, n_documents, n_terms, top).withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
