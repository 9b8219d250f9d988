"""Substring search over stored events by a table of trigrams.

A search like ``%root%`` can't use sorted files or statistics.  The index holds, for every stored file, the distinct
trigrams of its searched columns.  A search looks up the trigrams that every match must contain and reads only the files that
hold all of them; the condition itself is tested on their rows, so the result is that of a search without the index.
Files that the index doesn't know yet are always read, and entries of files that are gone are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import like_term
from logweave.operators import search, store
from logweave.operators.flat import SEARCHED_COLUMNS

SIZE = 3
INDEX_DDL = "gram STRING, file STRING"
#: Every column's grams are told apart: a term must stand in one column.
_FIRST = {column: chr(97 + k) for k, column in enumerate(SEARCHED_COLUMNS)}


def grams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    last = F.greatest(F.length(text) - (SIZE - 1), F.lit(0))
    places = F.slice(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), F.lit(1), last)
    return F.array_distinct(F.transform(places, lambda k: F.substring(text, k, F.lit(SIZE))))


def _tagged(found: Column, tag: str) -> Column:
    return F.transform(found, lambda gram: F.concat(F.lit(tag), gram))


def _files(table: DataFrame) -> DataFrame:
    """``file`` and ``gram`` of stored rows; equal ones combine before the shuffle."""
    columns = [_tagged(grams(F.coalesce(F.col(c), F.lit(""))), tag) for c, tag in _FIRST.items()]
    # A file without any gram is known too.
    return table.select(
        F.explode(F.concat(F.array(F.lit("")), *columns)).alias("gram"), F.col("_metadata.file_path").alias("file")
    ).distinct()


def _indexed(spark: SparkSession, index_path: str) -> DataFrame | None:
    return store.if_there(lambda: spark.read.schema(INDEX_DDL).parquet(index_path))


def current_files(table: DataFrame) -> dict[str, str]:
    """Stored files by their name as rows give it."""
    return {_plain(f): f for f in table.inputFiles()}


def plain_path(path: Column) -> Column:
    """A path however many slashes follow its scheme, as :func:`current_files` names it."""
    return F.regexp_replace(path, r"^([a-z0-9]+):/+", "$1:/")


def _plain(path: str) -> str:
    """A path however many slashes follow its scheme."""
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", path)


def update_index(spark: SparkSession, path: str, index_path: str) -> int:
    """Index the stored files that aren't yet, and return how many there were; to be called after a load."""
    table = store.read_events(spark, path)
    files, known = current_files(table), _indexed(spark, index_path)
    if known is not None:
        for row in known.filter("gram = ''").select("file").toLocalIterator():
            files.pop(_plain(row["file"]), None)
    if files:
        new = _files(store.read_events(spark, *files.values(), base=path))
        # Sorted by trigram, so that a lookup skips most of a file.
        new.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("append").parquet(index_path)
    return len(files)


def needed_grams(term: str) -> list[str]:
    """Trigrams of the texts between the wildcards ``%`` and ``_`` of a search; a backslash escapes."""
    runs = [""]
    for escaped, wildcard, plain in re.findall(r"(?s)\\(.)|([%_])|(.)", like_term(term)):
        if wildcard:
            runs.append("")
        else:
            runs[-1] += escaped or plain
    return sorted({run[k : k + SIZE] for run in runs for k in range(len(run) - SIZE + 1)})


def candidate_files(spark: SparkSession, path: str, index_path: str, term: str) -> list[str]:
    """Stored files that can hold a match."""
    files, needed = current_files(store.read_events(spark, path)), needed_grams(term)
    known = _indexed(spark, index_path)
    if known is None or not needed:
        return sorted(files.values())
    tagged = [tag + gram for gram in needed for tag in _FIRST.values()]
    hits = known.filter(F.col("gram").isin(["", *tagged])).groupBy("file").agg(*[
        F.count_if(F.startswith("gram", F.lit(tag))).alias(tag) for tag in _FIRST.values()])
    missed = hits.filter(" AND ".join(f"{tag} < {len(needed)}" for tag in _FIRST.values()))
    for row in missed.select("file").toLocalIterator():
        files.pop(_plain(row["file"]), None)
    return sorted(files.values())


def find_indexed(spark: SparkSession, path: str, index_path: str, search_term: str, **filters) -> DataFrame:
    """:func:`search.find_events` that reads only files with candidates."""
    files = candidate_files(spark, path, index_path, search_term)
    table = store.read_events(spark, *files, base=path) if files else store.read_events(spark, path).limit(0)
    return search.find_events(table, search=search_term, **filters)
