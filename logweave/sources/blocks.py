"""Records of large files, cut by many tasks: CSV rows with breaks in cells, elements of JSON arrays.

A file is read in splits as Spark plans them, in pieces that end with a separator: lines for CSV, texts up to closing braces
for JSON, or longer ones (:func:`_separator`).  Whether a piece begins inside quotes depends on everything before it, so each
piece first says what it does to either state (a swap, or an end that is the same for both); a block's pieces (a bounded run
of a split's) compose to one such function, and running over the blocks of a file, a row each, gives every block its true
start.  Then each block cuts its own records.  Only what crosses the border of blocks, at most two fragments a block, is put
together between them.

The pieces are written once to the shared folder, so that their blocks and places stay what they were however often
they are read, by whichever executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.fixed_values import WHITE_SPACE
from logweave.functions.shape import scratch_path

FILE = "source_file"
#: What is windowed and gathered as one: at most 2**14 pieces that follow each other in a split of a file.  A split of
#: short pieces holds millions, which no task is to sort and buffer alone.
BLOCK = [FILE, "_start", "_part"]
_PART_BITS = 14

# A closed CSV cell and what may follow it in a record; a lone carriage return ends a record as well.
_QUOTED = r'(?:[^"]++|"")*+'
_CLOSED = rf'(?:"{_QUOTED}"[^,\r\n]*+|[^,"\r\n][^,\r\n]*+|)'
_OPENS = rf'(?:{_CLOSED}[,\r\n])*+"{_QUOTED}\z'
_LEFT_OPEN = rf"\A{_OPENS}"
_BLANK_END = rf"(?:\n[{WHITE_SPACE}]*+)++\z"
_STAYS_OPEN = rf'\A{_QUOTED}(?:\z|"[^,\r\n]*+[,\r\n]{_OPENS})'

# Separators that make pieces of whole records from lines or braces inside texts: a quote that ends a line; a brace and a
# quote, which is escaped in texts.
_CSV_LONGER = ('"\n', '"\r\n')
_JSON_LONGER = ('{"',)
#: Bytes of the longest of these pieces, how many short ones one must replace on average, the fewest short ones that are worth
#: it, and bits of their number in a block.
_LONGEST, _FEWER, _MANY, _LONG_PART_BITS = 1 << 16, 4, 1000, 10


def _sized(
    spark: SparkSession, path: str, separator: str, max_file_mb: float | None, longest: int | None = None
) -> DataFrame:
    """Number of pieces and bytes of each file, a separator after the last piece included; pieces over ``longest`` are skipped."""
    read = spark.read.option("lineSep", separator)
    if longest is not None:
        read = read.option("mapreduce.input.linerecordreader.line.maxlength", longest)
    pieces = _within_limit(read.text(path), max_file_mb)
    return _written(pieces.groupBy(F.col("_metadata.file_path").alias(FILE)).agg(
        F.count(F.lit(1)).alias("_pieces"), F.sum(F.octet_length("value") + len(separator)).alias("_bytes")), "sizes")


def _separator(
    spark: SparkSession, path: str, short: str, longer: tuple[str, ...], max_file_mb: float | None
) -> tuple[str, DataFrame | None]:
    """What to read pieces up to, and whether a file ends with it (``_ended``, where it isn't ``short``).

    A longer separator is taken if it makes far fewer pieces and none of them is long: then the bytes are those that
    ``short`` gives, so that none was skipped.
    """
    by_short = _sized(spark, path, short, max_file_mb)
    for separator in longer:
        by_long = _sized(spark, path, separator, max_file_mb, _LONGEST).select(
            FILE, F.col("_pieces").alias("_long_pieces"), F.col("_bytes").alias("_long_bytes"))
        both = by_short.join(by_long, FILE, "left")
        whole = F.coalesce(F.col("_long_bytes") >= F.col("_bytes") - len(short), F.lit(False))
        fits, pieces, long_pieces = both.agg(F.every(whole), F.sum("_pieces"), F.sum("_long_pieces")).first()
        if fits and long_pieces * _FEWER <= pieces and pieces >= _MANY:
            return separator, both.select(FILE, (F.col("_long_bytes") == F.col("_bytes")).alias("_ended"))
    return short, None


def _within_limit(rows: DataFrame, max_file_mb: float | None) -> DataFrame:
    return rows if max_file_mb is None else rows.filter(F.col("_metadata.file_size") <= max_file_mb * 1024 * 1024)


def read_pieces(
    spark: SparkSession, path: str, separator: str, max_file_mb: float | None, columns: dict[str, Column],
    raw: Column | None = None, part_bits: int | None = None,
) -> DataFrame:
    """``raw``, ``source_file``, the split's ``_start``, the ``_place`` in it, its ``_part`` and further columns of ``raw``, written.

    The separator is not in the text, unless ``raw``, an expression of ``raw``, puts it there.
    """
    read = _within_limit(spark.read.option("lineSep", separator).text(path), max_file_mb)
    pieces = read.select(
        F.make_valid_utf8("value").alias("raw"), F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place"),
    )
    if raw is not None:
        pieces = pieces.withColumn("raw", raw)
    bits = _PART_BITS if part_bits is None else min(part_bits, _PART_BITS)
    return _written(pieces.select(
        "*", F.shiftright("_place", bits).alias("_part"), *[column.alias(name) for name, column in columns.items()]), "pieces")


def _written(rows: DataFrame, name: str) -> DataFrame:
    folder = scratch_path(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _before(order: Window) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def _so_far(order: Window) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _odd(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) % 2 == 1


def fragments(pieces: DataFrame, begins: str, goes_on: str, separator: str, places: list[str] = ["_place"]) -> DataFrame:  # noqa: B006
    """Records of pieces that say whether they begin a record and whether their record goes on after them.

    ``source_file``, ``_start`` and ``_place`` of the record's first piece, ``raw``, and ``_open``: the file ends in it.
    ``places`` order the pieces of a block.
    """
    order = Window.partitionBy(*BLOCK).orderBy(*places)
    numbered = pieces.withColumn("_record", F.count_if(begins).over(_so_far(order)))
    texts = F.array_sort(F.collect_list(F.struct(*places, "raw")))
    # Both parts below read them, so they are written once.
    found = _written(numbered.groupBy(*BLOCK, "_record").agg(
        texts.alias("_texts"), F.max_by(goes_on, F.struct(*places)).alias("_open")
    ).select(
        *BLOCK, "_record", F.col("_texts")[0]["_place"].alias("_place"), "_open",
        F.array_join(F.col("_texts.raw"), separator).alias("raw"),
    ), "records")
    names = [*BLOCK, "_place", "raw", "_open"]
    inside = found.filter("_record > 0 AND NOT _open").select(names)
    # Record 0 of a block is the rest of one that began in a block before.
    along = Window.partitionBy(FILE).orderBy("_start", "_part", "_record")
    crossing = found.filter("_record = 0 OR _open").withColumn(
        "_chain", F.count_if(F.col("_record") > 0).over(_so_far(along)))
    parts = F.array_sort(F.collect_list(F.struct("_start", "_part", "_record", "_place", "raw", "_open")))
    joined = crossing.groupBy(FILE, "_chain").agg(parts.alias("_parts")).select(
        FILE, *[F.col("_parts")[0][name].alias(name) for name in ("_start", "_part", "_place")],
        F.array_join(F.col("_parts.raw"), separator).alias("raw"),
        F.element_at("_parts", -1)["_open"].alias("_open"),
    )
    return inside.unionByName(joined.select(names))


# ---- CSV ------------------------------------------------------------------------


def _left_open(raw: Column) -> Column:
    return F.contains(raw, F.lit('"')) & raw.rlike(_LEFT_OPEN)


def _stays_open(raw: Column) -> Column:
    return ~F.contains(raw, F.lit('"')) | raw.rlike(_STAYS_OPEN)


def csv_pieces(spark: SparkSession, path: str, max_file_mb: float | None) -> DataFrame:
    """Lines or runs of lines, and whether a cell is open after each: ``_from_out`` and ``_from_in`` by the state before it."""
    separator, ended = _separator(spark, path, "\n", _CSV_LONGER, max_file_mb)
    raw = F.col("raw")
    flags = {"_from_out": _left_open(raw), "_from_in": _stays_open(raw)}
    if ended is None:
        return read_pieces(spark, path, separator, max_file_mb, flags)
    # Pieces are joined by line ends; what stands before one in the separator is put back.
    rest = separator[:-1]
    pieces = read_pieces(spark, path, separator, max_file_mb, flags, F.concat("raw", F.lit(rest)), _LONG_PART_BITS)
    at = F.struct("_start", "_place")
    ends = _written(pieces.groupBy(FILE).agg(F.max(at).alias("_end")).join(ended.filter("NOT _ended"), FILE).select(
        FILE, "_end"), "ends")
    # The last piece of a file that ends otherwise did not have it; blank lines at the end are no records.
    last = F.coalesce(at == F.col("_end"), F.lit(False))
    own = F.regexp_replace(F.expr(f"left(raw, length(raw) - {len(rest)})"), _BLANK_END, "")
    return pieces.join(ends, FILE, "left").withColumn("_last", last).select(
        F.when(F.col("_last"), own).otherwise(raw).alias("raw"), *BLOCK, "_place",
        F.when(F.col("_last"), _left_open(own)).otherwise(F.col("_from_out")).alias("_from_out"),
        F.when(F.col("_last"), _stays_open(own)).otherwise(F.col("_from_in")).alias("_from_in"),
    )


def csv_blocks(pieces: DataFrame) -> DataFrame:
    """``_entry`` of each block: whether it begins inside a cell.  A row per block, sums combine map-side."""
    # Place and state as one number, which is gathered by hash.
    fixed = F.when(F.col("_from_out") == F.col("_from_in"), 2 * F.col("_place") + F.col("_from_out").cast("int"))
    swaps = F.col("_from_out") & ~F.col("_from_in")
    lines = pieces.select(*BLOCK, "_place", "_from_out", "_from_in")
    blocks = lines.groupBy(*BLOCK).agg(F.max(fixed).alias("_fixed"), F.count_if(swaps).alias("_all"))
    # Swaps after the last line whose end does not depend on its start.
    after = lines.filter(swaps).join(blocks.select(*BLOCK, "_fixed"), BLOCK).filter(
        2 * F.col("_place") > F.col("_fixed")).groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_after"))
    order = Window.partitionBy(FILE).orderBy("_start", "_part")
    swapped = blocks.join(after, BLOCK, "left").select(
        *BLOCK, _odd(F.sum("_all").over(_so_far(order))).alias("_turned"),
        _odd(F.sum("_all").over(_before(order))).alias("_turned_before"),
        ((F.col("_fixed") % 2 == 1) != _odd(F.col("_after"))).alias("_end"),
    )
    known = F.last(F.col("_end") != F.col("_turned"), ignorenulls=True).over(_before(order))
    return swapped.select(*BLOCK, (F.coalesce(known, F.lit(False)) != F.col("_turned_before")).alias("_entry"))


def csv_records(pieces: DataFrame) -> DataFrame:
    """Records of CSV files as :func:`fragments` gives them; the header and blank lines are records as well."""
    order = Window.partitionBy(*BLOCK).orderBy("_place")
    swaps = F.col("_from_out") & ~F.col("_from_in")
    fixed = F.when(F.col("_from_out") == F.col("_from_in"), F.col("_from_out") != F.col("_turned"))
    states = (
        pieces.join(csv_blocks(pieces), BLOCK)
        .withColumn("_turned", _odd(F.count_if(swaps).over(_so_far(order))))
        .withColumn("_known", F.last(fixed, ignorenulls=True).over(_so_far(order)))
        .withColumn("_inside", F.coalesce("_known", "_entry") != F.col("_turned"))
        .withColumn("_begins", ~F.coalesce(F.lag("_inside").over(order), F.col("_entry")))
    )
    return fragments(states, "_begins", "_inside", "\n")


# ---- JSON -----------------------------------------------------------------------

_STRING = r'"(?:[^"\\]++|\\.)*+(?:"|\\?\z)'
# Text up to a brace outside strings, or without one; a backslash outside strings is none's.
_TOKEN = rf'(?:[^"}}\\]++|\\[^}}]?+|{_STRING})'
_TO_BRACE = rf"(?s){_TOKEN}*+\}}|{_TOKEN}++"


def _braces(text: Column) -> Column:
    """Brackets outside strings."""
    return F.regexp_replace(F.regexp_replace(text, f"(?s){_STRING}", ""), r"[^\[\]{}]++", "")


def _depth(braces: Column) -> Column:
    opening = F.length(F.regexp_replace(braces, r"[^\[{]++", ""))
    return (2 * opening - F.length(braces)).cast("long")


def _lowest(braces: Column) -> Column:
    """Lowest depth after a bracket, from 0 at the start; null where no array ends, as the depth at the end tells then."""
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("low"))

    def step(state, brace):
        at = state["at"] + F.when(brace.isin("[", "{"), 1).otherwise(-1)
        return F.struct(at.alias("at"), F.least(state["low"], at).alias("low"))

    walk = F.aggregate(F.filter(F.split(braces, ""), lambda c: c != ""), start, step)
    return F.when(F.contains(braces, F.lit("]")), walk["low"]).cast("long")


def _outer(raw: Column) -> dict[str, Column]:
    """First character that is no white space, whether the last one ends an array, and whether there is none."""
    blanks = F.lit(" \t\r\n")
    begin = F.ltrim(raw, blanks)
    return {"_first": F.substring(begin, 1, 1), "_closed": F.endswith(F.rtrim(raw, blanks), F.lit("]")), "_blank": begin == ""}


def json_pieces(spark: SparkSession, path: str, max_file_mb: float | None) -> DataFrame:
    """Texts up to braces that are outside strings, or to where they were read to; ``_place`` and ``_sub`` are their order.

    ``_by``: what they add to the depth, ``_low``: the lowest one in them, ``_closes``: a brace is at their end.
    """
    separator, ended = _separator(spark, path, "}", _JSON_LONGER, max_file_mb)
    quotes = F.length(F.replace(F.regexp_replace("raw", r'(?s)[^"\\]++|\\.', ""), F.lit("\\")))
    read = read_pieces(
        spark, path, separator, max_file_mb, {
            "_swaps": (quotes + separator.count('"')) % 2 == 1, "_odd_end": quotes % 2 == 1,
            **_outer(F.col("raw")),
        }, None, None if ended is None else _LONG_PART_BITS)
    at = F.struct("_start", "_place")
    files = _written(read.groupBy(FILE).agg(
        F.max(at).alias("_end"), F.min_by("_first", F.when(~F.col("_blank"), at)).alias("_file_first")), "ends")
    blocks = read.groupBy(*BLOCK).agg(F.count_if("_swaps").alias("_all"))
    blocks = blocks.withColumn(
        "_entry", _odd(F.sum("_all").over(_before(Window.partitionBy(FILE).orderBy("_start", "_part"))))).drop("_all")
    order = Window.partitionBy(*BLOCK).orderBy("_place")
    inside = F.col("_entry") != _odd(F.count_if("_swaps").over(_before(order)))
    # Whether a file ends with the separator is not known: an object does so with a brace, an array with its bracket.
    # An empty piece has the separator behind it, or there would be none.
    array = (F.col("_blank") & (F.col("raw") != "")) | (F.col("_closed") & (F.col("_file_first") == "["))
    none = (at == F.col("_end")) & (array if ended is None else F.lit(True))
    texts = (
        read.join(blocks, BLOCK).join(files, FILE)
        .withColumn("_inside", inside).withColumn("_without", none)
        .withColumn("_text", F.concat(
            F.when(F.col("_inside"), '"').otherwise(""), "raw", F.when(F.col("_without"), "").otherwise(separator)))
        .withColumn("_open_end", F.col("_inside") != F.when(F.col("_without"), F.col("_odd_end")).otherwise(F.col("_swaps")))
    )
    cut = F.regexp_extract_all("_text", F.lit(_TO_BRACE), F.lit(0))
    # A file's last piece may be empty, and stays as one that is.
    cut = F.when(F.col("_text") == "", F.array(F.lit(""))).otherwise(cut)
    rows = texts.withColumn("_cut", cut).select(
        *BLOCK, "_place", "_inside", "_open_end", F.size("_cut").alias("_cuts"), F.posexplode("_cut").alias("_sub", "_text"))
    began = F.col("_inside") & (F.col("_sub") == 0)
    raw = F.when(began, F.expr("substring(_text, 2)")).otherwise(F.col("_text"))
    string = F.col("_open_end") & (F.col("_sub") == F.col("_cuts") - 1)
    return _written(rows.select(
        *BLOCK, "_place", "_sub", raw.alias("raw"), _braces(F.col("_text")).alias("_braces"), string.alias("_string"),
    ).select(
        *BLOCK, "_place", "_sub", "raw", "_string", _depth(F.col("_braces")).alias("_by"), _lowest(F.col("_braces")).alias("_low"),
        (F.endswith("raw", F.lit("}")) & ~F.col("_string")).alias("_closes"),
        *[column.alias(name) for name, column in _outer(F.col("raw")).items()],
    ), "cuts")


def json_blocks(pieces: DataFrame) -> DataFrame:
    """``_depth`` at the start of each block, and whether a record ``_goes_before``.  A row per block."""
    blocks = pieces.groupBy(*BLOCK).agg(
        F.sum("_by").alias("_all"), F.max_by("_closes", F.struct("_place", "_sub")).alias("_closing"))
    order = Window.partitionBy(FILE).orderBy("_start", "_part")
    depth = F.coalesce(F.sum("_all").over(_before(order)), F.lit(0))
    return blocks.select(*BLOCK, depth.alias("_depth"), (
        (depth != 1) | ~F.coalesce(F.lag("_closing").over(order), F.lit(False))).alias("_goes_before"))


def json_states(pieces: DataFrame) -> DataFrame:
    """Pieces with ``_begins``, ``_goes_on``, the depth ``_to`` after them and the lowest one in them."""
    order = Window.partitionBy(*BLOCK).orderBy("_place", "_sub")
    return (
        pieces.join(json_blocks(pieces), BLOCK)
        .withColumn("_to", F.col("_depth") + F.sum("_by").over(_so_far(order)))
        .withColumn("_low", F.col("_to") - F.col("_by") + F.col("_low"))
        .withColumn("_goes_on", (F.col("_to") != 1) | ~F.col("_closes"))
        .withColumn("_begins", ~F.coalesce(F.lag("_goes_on").over(order), F.col("_goes_before")))
    )


def json_kinds(states: DataFrame) -> DataFrame:
    """``kind`` of each file: one ``array``, one ``object``, or else ``lines``.  No text is looked at."""
    at = F.struct("_start", "_place", "_sub")
    filled = F.when(~F.col("_blank"), at)
    last = F.max_by(F.struct("_closed", "_to", "_low", "_string"), filled)
    below = ~F.col("_blank") & ((F.col("_to") < 1) | (F.coalesce("_low", F.lit(1)) < 1))
    files = states.groupBy(FILE).agg(
        F.min_by("_first", filled).alias("_first"), last.alias("_last"),
        F.count_if(below).alias("_below"),
        F.count_if((F.col("_to") == 0) & F.col("_closes")).alias("_objects"),
        F.count_if((F.col("_to") - F.col("_by") <= 0) & ~F.col("_blank")).alias("_outside"),
    )
    array = ((F.col("_first") == "[") & F.col("_last._closed") & ~F.col("_last._string") & (F.col("_last._to") == 0)
             & (F.col("_last._low") == 0) & (F.col("_below") == 1))
    # Nothing begins outside an object but itself.
    alone = (F.col("_first") == "{") & (F.col("_objects") == 1) & (F.col("_outside") == 1)
    return files.select(FILE, F.when(array, "array").when(alone, "object").otherwise("lines").alias("_kind"))


def json_elements(states: DataFrame) -> DataFrame:
    """``source_file`` and ``_elements`` (JSON texts) of the records of files that are one array each.

    Text that is no JSON stays as it is.
    """
    found = fragments(states, "_begins", "_goes_on", "", ["_place", "_sub"])
    whole = F.when(F.col("_open"), F.regexp_replace("raw", r"\]\s*+\z", "")).otherwise(F.col("raw"))
    text = F.regexp_replace(whole, r"\A\s*+[\[,]", "")
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    return found.select(FILE, F.coalesce(parsed, F.array(text)).alias("_elements"))
