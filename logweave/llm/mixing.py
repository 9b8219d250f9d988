"""Mixing sources to target weights by capped water-filling.

Each source is to fill its weight's share of all words, but none more than ``max_epochs``
times its own words; what a capped source can't take goes to the others by weight, until none is above its cap.
Whole repetitions go to every document of a source, the fraction that is left to the first
documents in a seeded order of hashes.

* Null sources form one source of their own; null or empty texts have size 0 and are taken
  as often as their source's whole repetitions (0 words each).
* Repeated rows are documents of their own; equal hashes tie by size, so which of two equal rows is
  taken doesn't show in the result.
* An empty table gives an empty result.  Other columns of the input stay; those named like
  the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import common

#: Hex digits of the hash that deal the documents of a source into ranges: 4096 of them.
RANGE_DIGITS = 3
#: What ``mix_counts`` adds.
NEW = ("size", "source_size", "target", "repeats", "taken")


def source_key(source: Column) -> Column:
    """The source as a key without nulls; null comes after every other one."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights 1, 2, 3, 1, ... of sources (one row each) by code point.

    The order is that of one small table, a row per source; documents never pass here.
    """
    rank = F.row_number().over(Window.orderBy("mix_key")) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.withColumn("weight", F.element_at(weights, (rank % len(cycle) + 1).cast("int")))


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to a table of ``source_size`` and ``weight``.

    Each round is one aggregate over the sources and returns three numbers: the words of the capped
    sources, the weight of the others and their count.  Capped sources stay capped, so it ends.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        held, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.count_if(over),
        ).first()
        if n == capped or weight == 0:
            break
        level, capped = (total - held) / weight, n
    level = F.lit(level if level is not None else 0.0)
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def mix_counts(
    documents: DataFrame,
    weights=cyclic_weights,
    max_epochs: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """The documents with ``size, source_size, target, repeats, taken``.

    ``weights`` adds a column ``weight`` to the table of sources (``mix_key, source_size``).
    Running totals inside a source are summed in 4096 ranges of the hash, so a source that holds
    a third of all rows is dealt over the cluster.
    """
    names = [c for c in documents.columns if c.lower() not in NEW]
    # The input's other columns travel in a struct, whatever their names.
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("mix_row"),
        source_key(F.col("source")).alias("mix_key"),
        common.word_count(F.col("text")).alias("size"),
        F.md5(F.concat(
            F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
        )).alias("mix_order"),
    ).withColumn("mix_range", F.substring("mix_order", 1, RANGE_DIGITS))
    ranges = common.written(
        rows.groupBy("mix_key", "mix_range").agg(F.sum("size").alias("range_size")), "mix-ranges"
    )
    sources = common.written(
        weights(ranges.groupBy("mix_key").agg(F.sum("range_size").alias("source_size"))), "mix-sources"
    )
    before = Window.partitionBy("mix_key").orderBy("mix_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(water_fill(sources, max_epochs), "mix_key")
        .select("mix_key", "mix_range", "range_start", "source_size", "target")
    )
    inside = Window.partitionBy("mix_key", "mix_range").orderBy("mix_order", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        rows.join(starts, ["mix_key", "mix_range"])
        .withColumn("mix_start", start)
        .withColumn(
            "repeats",
            # Where nothing is left over, empty documents at the front get nothing more either.
            whole + F.when((rest > 0) & (F.col("mix_start") + F.col("size") / 2.0 <= rest), 1).otherwise(0),
        )
        .withColumn("taken", F.col("size") * F.col("repeats"))
        .select("mix_row.*", *NEW)
    )


def mixed(documents: DataFrame, weights=cyclic_weights, max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    rows = documents.select("doc_id", "text", "source", F.struct(*documents.columns).alias("mix_row"))
    return (
        mix_counts(rows, weights, max_epochs, seed)
        .filter(F.col("repeats") > 0)
        .select("mix_row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
        .select("mix_row.*")
    )
