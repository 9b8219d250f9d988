"""Language of texts by cross-parsing entropy.

For each language a suffix automaton of a sample of its labelled texts is built.  A text is parsed greedily
into phrases, each the longest string that occurs in the sample, plus the character that ended it; the language that
needs the fewest phrases per character wins.  The automata are one transition table, and all texts of a
batch walk through it in step, as arrays.

* Letters are lower-cased, every other run of characters becomes one space; texts without a letter and null texts are ``und`` with score 0.
* Whole texts are parsed, in pieces of ``PIECE`` characters that each begin a new phrase, for every language alike.
* Ties go to the language that comes first by code point.
* The sample: of each language the ``rows`` labelled texts that come first in a seeded hash order, from each
  a stretch from a place that the hash also picks, all of the same length: so much that all rows taken fill ``chars``
  characters, short texts included.  A language with few rows is so learned from longer stretches.  This bound is for learning only.
* A larger sample knows more strings, so a text needs fewer phrases of it by chance; counts are therefore multiplied by the
  logarithm of the sample's length, to which the length of a longest match grows in proportion.
* Repeated rows are predicted alike; an empty table gives an empty result; without any labelled text every row is ``und``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import common

UNKNOWN = "und"
#: Characters that walk through the automata together; longer texts are several pieces.
PIECE = 256
#: Code points that have an own class of characters, others are classed as "other letter".
PLANE = 1 << 16


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(documents: DataFrame, rows: int = 512, chars: int = 40_960) -> list[tuple[str, str]]:
    """At most ``rows`` excerpts of each language.

    Spark keeps the first rows per language in each task before the shuffle, so a large language isn't gathered.  The table of ids
    that is broadcast has ``rows`` rows per language at most (more only where rows repeat an id).
    """
    usable = documents.filter(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = [F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id"), F.xxhash64("text")]
    first = Window.partitionBy("lang").orderBy(*order)
    # The ids alone are ranked, at most ``rows`` of a language; then their texts are fetched.
    picked = usable.select("lang", "doc_id", F.row_number().over(first).alias("k")).filter(F.col("k") <= rows)
    ids = picked.select("lang", F.col("doc_id").alias("id")).distinct()
    # No text gives more than all of the budget; what each gives follows from the number of rows taken.
    excerpt = (f"substring(text, cast(pmod(xxhash64(7, doc_id), greatest(char_length(text) - {chars // rows}, 0) + 1) "
               f"as int) + 1, {chars})")
    found = (
        usable.withColumnRenamed("lang", "of").join(
            F.broadcast(ids), (F.col("of") == F.col("lang")) & F.col("doc_id").eqNullSafe(F.col("id")))
        .select("lang", F.expr(excerpt).alias("excerpt"), F.row_number().over(first).alias("k"))
        .filter(F.col("k") <= rows)
    )
    taken = Window.partitionBy("lang").orderBy(F.char_length("excerpt"), "k")
    # The shortest come first: what they leave of the budget is dealt to the others.
    left = F.lit(chars) - F.coalesce(
        F.sum(F.char_length("excerpt")).over(taken.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.ceil(left / (F.count(F.lit(1)).over(Window.partitionBy("lang")) - F.row_number().over(taken) + 1))
    dealt = found.withColumn("share", share).groupBy("lang").agg(
        F.max(F.when(F.col("share") < F.char_length("excerpt"), F.col("share"))).alias("cut"))
    kept = found.join(dealt, "lang").select(
        "lang", "k", F.expr("substring(excerpt, 1, cast(coalesce(cut, char_length(excerpt)) as int))").alias("excerpt"))
    return [(r["lang"], r["excerpt"]) for r in kept.orderBy("lang", "k").collect()]


def automaton(text: np.ndarray, classes: int) -> np.ndarray:
    """Transition table of the suffix automaton of a coded text; 0 means none, 1 is the root."""
    most = 2 * len(text) + 2
    table = np.zeros((most, classes), np.int32)
    link, length = [0] * most, [0] * most
    link[1], last, size = 0, 1, 2
    for c in text.tolist():
        new, p = size, last
        size += 1
        length[new] = length[last] + 1
        while p and not table[p, c]:
            table[p, c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = int(table[p, c])
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = size
                size += 1
                length[copy] = length[p] + 1
                table[copy] = table[q]
                link[copy] = link[q]
                while p and table[p, c] == q:
                    table[p, c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return table[:size]


class Model:
    """The automata of all languages in one flat table, and the classes of characters."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in rows})
        letters = sorted({c for _, text in rows for c in text.lower() if c.isalpha() and ord(c) < PLANE})
        #: 0: a letter that no sample has; 1: the gap; others: the letters
        self.classes = len(letters) + 2
        self.code = np.ones(PLANE + 1, np.uint16)
        for c in range(PLANE):
            if chr(c).isalpha():
                self.code[c] = 0
        self.code[PLANE] = 0
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 2
        tables, self.roots, sizes, at = [], [], [], 0
        for lang in self.langs:
            text = self.coded(" ".join(text for of, text in rows if of == lang))
            # Class 0 has no transition: an unknown letter always ends a phrase.
            table = automaton(text[text > 0], self.classes)
            tables.append(np.where(table > 0, table + at, 0))
            sizes.append(np.log(len(text) + 2))
            self.roots.append(at + 1)
            at += len(table)
        self.weight = np.array(sizes) / max(sizes, default=1.0)
        self.table = np.concatenate(tables).ravel().astype(np.int32) if tables else np.zeros(0, np.int32)

    def coded(self, text: str) -> np.ndarray:
        """Classes of a text, with one gap for each run of other characters, and none at its ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = self.code[np.minimum(points, PLANE)]
        gap = codes == 1
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        codes = codes[keep]
        if len(codes) and codes[0] == 1:
            codes = codes[1:]
        return codes[:-1] if len(codes) and codes[-1] == 1 else codes

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of every text in every language (texts x languages)."""
        pieces = np.array([-(-len(t) // PIECE) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), pieces)
        total = int(pieces.sum())
        flat = np.zeros(total * PIECE, np.uint16)
        length = np.full(total, PIECE, np.int64)
        ends = np.cumsum(pieces)
        for text, end, n in zip(texts, ends, pieces, strict=True):
            if n:
                begin = (end - n) * PIECE
                flat[begin : begin + len(text)] = text
                length[end - 1] = len(text) - (n - 1) * PIECE
        order = np.argsort(-length, kind="stable")
        steps = np.ascontiguousarray(flat.reshape(total, PIECE)[order].T)
        length, owner = length[order], owner[order]
        roots = np.array(self.roots, np.int64)[:, None] * self.classes
        states = np.broadcast_to(roots, (len(roots), total)).copy()
        counts = np.zeros((len(roots), total), np.int32)
        live = np.searchsorted(-length, -np.arange(PIECE), side="left")
        for k in range(PIECE):
            n = int(live[k])
            if not n:
                break
            now = self.table[states[:, :n] + steps[k, :n]].astype(np.int64)
            ended = now == 0
            counts[:, :n] += ended
            now *= self.classes
            np.copyto(now, roots, where=ended)
            states[:, :n] = now
        counts += states != roots  # the phrase that the end of the piece cuts off
        result = np.zeros((len(texts), len(roots)), np.int64)
        np.add.at(result, owner, counts.T)
        return result

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the second best phrase count's share of the two best."""
        known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known and self.langs:
            counts = self.phrases([self.coded(texts[k]) for k in known]) * self.weight
            best = counts.argmin(axis=1)
            two = np.sort(counts, axis=1)[:, :2].astype(float)
            share = two[:, -1] / np.maximum(two.sum(axis=1), 1) if two.shape[1] > 1 else np.ones(len(known))
            for k, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
                langs[k], scores[k] = self.langs[b], s
        return langs, scores


def predict(documents: DataFrame, rows: int = 512, chars: int = 40_960, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    The broadcast holds at most ``2 * chars`` states per language and a few dozen letter classes each.
    """
    spark = documents.sparkSession
    shared, key = spark.sparkContext.broadcast(training_rows(documents, rows, chars)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared)
        for batch in common.slices(batches, batch_bytes, "text"):
            langs, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").transform(common.arrow_map,
        run, "doc_id bigint, held_out boolean, lang_pred string, score double"
    )


_MODELS: dict[str, Model] = {}


def _model(key: str, shared) -> Model:
    """The model of a prediction, built once per Python worker."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(shared.value)
    return _MODELS[key]
