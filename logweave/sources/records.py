"""Finding records: in files, and in text columns that hold whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.fixed_values import LINE_BREAK, WHITE_SPACE
from logweave.functions.shape import EVENT_ID, scratch_path
from logweave.functions.text import strip
from logweave.sources import blocks, wel

SOURCE_FILE = "source_file"

# How one Sysmon element starts, and how it reads in full.
_EVENT_START = r"(?is)<Event(?:\s[^>]*)?>.*"
_EVENT_ELEMENT = r"(?is)<Event(?:\s[^>]*)?>.*?</Event>"


def _others(df: DataFrame, raw: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c != raw]


def _exploded(df: DataFrame, raw: str, pieces: Column) -> DataFrame:
    """A row per piece, and one with a NULL text for a document without any."""
    rows = df.select(*_others(df, raw), F.posexplode_outer(pieces).alias("_place", raw))
    return numbered_ids(rows, "_place").drop("_place")


def numbered_ids(rows: DataFrame, place: str) -> DataFrame:
    """Ids of a document extended by the place of the record, but for the first one."""
    if EVENT_ID not in rows.columns:
        return rows
    own = F.when(
        F.col(place) > 0, F.concat(F.col(EVENT_ID).cast("string"), F.lit("-"), F.col(place) + 1)
    ).otherwise(F.col(EVENT_ID).cast("string"))
    return rows.withColumn(EVENT_ID, own)


# ---- text columns -------------------------------------------------------------


def _text_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, LINE_BREAK), strip)
    return F.filter(lines, lambda line: line != "")


def syslog_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per line that is not blank."""
    return _exploded(df, raw, _text_lines(F.col(raw)))


def sysmon_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per ``<Event>`` element of a document or of bare fragments."""
    return _exploded(
        df, raw, F.regexp_extract_all(F.col(raw), F.lit(_EVENT_ELEMENT), F.lit(0))
    )


def wel_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per CSV row of a document with its own header."""
    return numbered_ids(wel.rows_from_text(df, raw), "_place").drop("_place")


def _json_pieces(text: Column, element: Column, line: Column) -> Column:
    """Elements of a JSON array, the one JSON object, or else the lines.

    A single object is recognized inside brackets, where a second value or text
    after the object shows; so several objects, one per line, stay lines.
    """
    boxed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    is_object = F.startswith(text, F.lit("{")) & (F.size(boxed) == 1)
    is_array = F.startswith(text, F.lit("[")) & (F.size(boxed) == 1)
    return (
        F.when(is_object, F.array(text)).when(is_array, element).otherwise(line)
    )


def _array_elements(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def _objects(elements: Column) -> Column:
    return F.filter(elements, lambda e: F.startswith(e, F.lit("{")))


def _alerts(elements: Column) -> Column:
    return F.transform(
        elements,
        lambda e: F.when(F.startswith(e, F.lit("{")), e).otherwise(
            F.concat(F.lit('{"_source":'), F.coalesce(F.to_json(F.array(e)), F.lit("[]")), F.lit("}"))
        ),
    )


def cef_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """CEF lines and JSON objects; array elements that are no objects are left out."""
    text = strip(F.col(raw))
    return _exploded(df, raw, _json_pieces(text, _objects(_array_elements(text)), _text_lines(text)))


def wazuh_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Alert objects; array elements that are no objects stay, as records that fail."""
    text = strip(F.col(raw))
    return _exploded(df, raw, _json_pieces(text, _alerts(_array_elements(text)), _text_lines(text)))


# ---- files --------------------------------------------------------------------


def _within_limit(df: DataFrame, max_file_mb: int | None) -> DataFrame:
    """Keep files up to the limit.  The test prunes whole files before they are read."""
    if max_file_mb is None:
        return df
    return df.filter(F.col("_metadata.file_size") <= max_file_mb * 1024 * 1024)


def rejected_files(
    spark: SparkSession, path: str, max_file_mb: float
) -> DataFrame:
    """Files over the limit.  Only their names and sizes are looked at."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .filter(F.col("length") > max_file_mb * 1024 * 1024)
        .select(F.col("_metadata.file_path").alias(SOURCE_FILE), F.col("length").alias("file_size"))
    )


def _read_text(spark: SparkSession, path: str, max_file_mb: int | None, **options) -> DataFrame:
    return _as_raw(_within_limit(spark.read.format("text").options(**options).load(path), max_file_mb))


def _as_raw(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.make_valid_utf8("value").alias("raw"),
        F.col("_metadata.file_path").alias(SOURCE_FILE),
    )


def read_lines(spark: SparkSession, path: str, max_file_mb: int | None = None) -> DataFrame:
    """Lines that are not blank, for syslog, CEF and JSON with one object per line."""
    lines = _within_limit(spark.read.text(path), max_file_mb)
    return _as_raw(lines.filter(_not_blank(F.col("value"))))


def _not_blank(line: Column) -> Column:
    """Told by the first byte where that is a visible ASCII character, so a long line is neither walked through nor copied."""
    return line.between("!", "~") | (F.ltrim(F.make_valid_utf8(line), F.lit(WHITE_SPACE)) != "")


def read_documents(
    spark: SparkSession, path: str, max_file_mb: float | None = None
) -> DataFrame:
    """Whole files, one row each, for JSON documents that span lines.

    A document is one task's work; ``rejected_files`` names those over a limit that is set.
    """
    return _read_text(spark, path, max_file_mb, wholetext=True)


def read_sysmon(spark: SparkSession, path: str, max_file_mb: int | None = None) -> DataFrame:
    """``<Event>`` elements of XML files; one large file is read by many tasks."""
    return fragments(_read_text(spark, path, max_file_mb, lineSep="</Event>"))


def fragments(pieces: DataFrame, raw: str = "raw") -> DataFrame:
    """Cut pieces that were split at the closing tag down to whole elements.

    What a file that breaks off leaves after its last element has open sections; it
    keeps its text without a closing tag, and its record is ``dropped``.
    """
    start = F.regexp_extract(F.col(raw), _EVENT_START, 0)
    closed = F.endswith(F.rtrim(F.col(raw)), F.lit(">"))
    for section in ("System", "EventData"):
        opened = F.col(raw).rlike(rf"(?i)<{section}[\s>]")
        closed = closed & (~opened | F.col(raw).rlike(rf"(?i)</{section}\s*>"))
    element = F.when(closed, F.concat(start, F.lit("</Event>"))).otherwise(start)
    return pieces.filter(F.col(raw).rlike(_EVENT_START[:-2])).select(
        element.alias(raw), *_others(pieces, raw)
    )


def read_json(
    spark: SparkSession, path: str, kind: str = "wazuh", max_file_mb: float | None = None
) -> DataFrame:
    """Records of JSON files: elements of an array, one object over many lines, or lines; plus ``source_file``.

    Large arrays are cut by many tasks, whether they have line ends or not.  ``kind`` is ``wazuh``, where elements that are no
    objects fail, or ``cef``, where they are left out.  An array with a broken element keeps its other records; a file
    that isn't one whole array or object is read by line.
    """
    chosen = {"wazuh": _alerts, "cef": _objects}[kind]
    pieces = blocks.json_pieces(spark, path, max_file_mb)
    folder = scratch_path(spark, "kinds")
    blocks.json_kinds(blocks.json_states(pieces.drop("raw"))).write.parquet(folder)
    kinds = spark.read.schema(f"{SOURCE_FILE} string, _kind string").parquet(folder)

    def of(rows: DataFrame, wanted: str) -> DataFrame:
        return rows.join(kinds.filter(F.col("_kind") == wanted), SOURCE_FILE, "left_semi")

    elements = blocks.json_elements(blocks.json_states(of(pieces, "array")))
    parts = F.array_sort(F.collect_list(F.struct("_start", "_place", "_sub", "raw")))
    objects = of(pieces, "object").groupBy(SOURCE_FILE).agg(parts.alias("_parts")).select(
        strip(F.array_join("_parts.raw", "")).alias("raw"), SOURCE_FILE)
    return (
        elements.select(F.explode(chosen(F.col("_elements"))).alias("raw"), SOURCE_FILE)
        .unionByName(objects)
        .unionByName(_by_line(spark, path, kinds, max_file_mb).select("raw", SOURCE_FILE))
    )


# So many files are told by name, of which Spark lists all; a join tells more.
_MOST_NAMES = 1000


def _by_line(spark: SparkSession, path: str, kinds: DataFrame, max_file_mb: float | None = None) -> DataFrame:
    """Lines of the files that are read by line.  The others, each maybe one line of its whole length, are not opened."""
    files = kinds.filter("_kind = 'lines'").select(SOURCE_FILE)
    names = [row[0] for row in files.limit(_MOST_NAMES + 1).collect()]
    if len(names) > _MOST_NAMES:
        return read_lines(spark, path, max_file_mb).join(files, SOURCE_FILE, "left_semi")
    named = F.col("_metadata.file_path").isin(names) if names else F.lit(False)
    lines = spark.read.text(path).filter(named).select(
        F.make_valid_utf8("value").alias("raw"), F.col("_metadata.file_path").alias(SOURCE_FILE))
    return lines.filter(strip(F.col("raw")) != "")


def read_wel(
    spark: SparkSession,
    path: str,
    multi_line: bool = True,
    max_file_mb: float | None = None,
) -> DataFrame:
    """Rows of CSV exports, each file with a header of its own, plus ``source_file``.

    Cells may hold line breaks; a large file is still cut by many tasks (see :mod:`logweave.sources.blocks`).
    ``multi_line=False`` is for files known to have no breaks in cells: no shuffle is needed then, and a line with an
    open quote fails.  Cells are found by position, so that orders, repeated headers and headers that differ in case
    give what a text column with the same document gives.  A file without a row below its header gives none.
    """
    if multi_line:
        return _csv_records(blocks.csv_pieces(spark, path, max_file_mb))
    lines = _within_limit(spark.read.text(path), max_file_mb)
    rows = lines.select(
        strip(F.make_valid_utf8("value")).alias("raw"),
        F.col("_metadata.file_path").alias(SOURCE_FILE),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    ).filter("raw <> ''")
    # A file's header is the first line of its first block; lines of a block keep their order.
    first = rows.filter("_start = 0").groupBy(SOURCE_FILE).agg(F.min(F.struct("_place", "raw")).alias("_first"))
    headers = _written_headers(first.select(
        SOURCE_FILE, F.col("_first._place").alias("_at"), wel.header_cells(F.col("_first.raw")).alias("_header")))
    below = rows.join(headers, SOURCE_FILE).filter("_place <> _at")
    return wel.rows_from_lines(below.select("raw", SOURCE_FILE, "_header"))


def _written_headers(headers: DataFrame) -> DataFrame:
    """The table of headers, a row per file, is written first, so that Spark knows its size when it picks the join."""
    folder = scratch_path(headers.sparkSession, "headers")
    headers.write.parquet(folder)
    return headers.sparkSession.read.schema(headers.schema).parquet(folder)


def _csv_records(pieces: DataFrame) -> DataFrame:
    at = F.struct("_start", "_place")
    filled = strip(F.col("raw")) != ""
    # Numbers alone are gathered by hash, map-side; the texts of first lines are looked up.
    places = pieces.filter(filled).groupBy(SOURCE_FILE, "_start").agg(F.min("_place").alias("_low"), F.max("_place").alias("_high"))
    bounds = _written_headers(places.groupBy(SOURCE_FILE).agg(
        F.min(F.struct("_start", F.col("_low").alias("_place"))).alias("_at"),
        F.max(F.struct("_start", F.col("_high").alias("_place"))).alias("_last")))
    ends = _written_headers(pieces.join(bounds, SOURCE_FILE).filter(at == F.col("_at")).select(
        SOURCE_FILE, F.struct("_start", "_place", "raw", "_from_out").alias("_first"), "_last"))
    found = blocks.csv_records(pieces)
    # A header over several lines is its file's first record; others have it in one line.
    longer = ends.filter("_first._from_out").select(SOURCE_FILE)
    cut = found.join(longer, SOURCE_FILE, "left_semi").filter(filled).groupBy(SOURCE_FILE).agg(
        F.min(F.struct("_start", "_place", "raw")).alias("_whole"))
    first = ends.join(cut, SOURCE_FILE, "left")
    # A carriage return alone ends a record as well.
    lines = wel.split_records(F.ltrim(F.coalesce("_whole.raw", "_first.raw"), F.lit(WHITE_SPACE)))
    headers = _written_headers(first.select(
        SOURCE_FILE, F.struct("_first._start", "_first._place").alias("_at"), "_last",
        wel.header_cells(lines[0]).alias("_header"), F.slice(lines, 2, F.size(lines)).alias("_rest")))
    records = found.join(headers, SOURCE_FILE).filter(at.between(F.col("_at"), F.col("_last")))
    rows = F.when(at == F.col("_at"), F.col("_rest")).otherwise(wel.split_records(F.col("raw")))
    return wel.rows_from_records(records.select(F.explode(rows).alias("raw"), SOURCE_FILE, "_header"))
