"""Windows Event Log CSV exports: one record per CSV row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import fixed_values as fixed
from logweave.functions.shape import EVENT_ID, computed_once, kept_columns, shape_event
from logweave.functions.text import (
    account_domain,
    account_name,
    base_name,
    empty_strings,
    sql_strip,
    sql_text,
    strip,
    whole_number,
)
from logweave.schema import inline_table

# Name of the column one past the header; a value there means too many cells.
EXTRA_CELL = "_extra"

# A CSV cell: quoted with doubled quotes inside, or plain.  Possessive, so long
# cells neither backtrack nor grow the stack.
_CELL = r'(?:"(?:[^"]++|"")*+(?:"|$)[^,\r\n]*+|[^,"\r\n][^,\r\n]*+|)'
_CSV_RECORD = rf"{_CELL}(?:,{_CELL})*+"


def event_table(spark) -> DataFrame:
    """The 28 Windows event codes with category, types, action, severity, outcome."""
    return inline_table(
        spark,
        fixed.WINDOWS_EVENTS,
        [
            ("_code", "bigint"), ("_category", "string"), ("_types", "array<string>"),
            ("_action", "string"), ("_severity", "bigint"), ("_outcome", "string"),
        ],
    )


def with_event_meaning(df: DataFrame, code: str) -> DataFrame:
    """Left join the event table (28 rows, fixed) on the event code column."""
    table = F.broadcast(event_table(df.sparkSession))
    return (
        df.join(table, df[code] == table["_code"], "left")
        .withColumn("_category", F.coalesce("_category", F.lit("process")))
        .withColumn("_types", F.coalesce("_types", F.array(F.lit("info"))))
        .withColumn(
            "_action",
            F.coalesce("_action", F.concat(F.lit("WEL event "), df[code].cast("string"))),
        )
        .withColumn("_severity", F.coalesce("_severity", F.lit(0)))
        .withColumn("_outcome", F.coalesce("_outcome", F.lit("unknown")))
        .drop("_code")
    )


def resolve_columns(headers: list[str]) -> dict[str, str | None]:
    """Header spelling that feeds each canonical column, None if there is none."""
    present = {h.strip(): h for h in headers}
    found = {}
    for name, spellings in fixed.WINDOWS_COLUMNS:
        hit = next((s for s in [*spellings, name] if s in present), None)
        found[name] = present[hit] if hit else None
    return found


def logon_type_name(logon_type: Column) -> Column:
    names = F.create_map(*[F.lit(cell) for row in fixed.LOGON_TYPES for cell in row])
    return F.coalesce(
        F.try_element_at(names, logon_type), F.concat(F.lit("type-"), logon_type)
    )


def cells(record: Column) -> Column:
    """Cells of a CSV record, without their quotes."""
    found = F.regexp_extract_all(
        F.concat(F.lit(","), record), F.lit(rf",({_CELL})"), F.lit(1)
    )
    return F.transform(
        found,
        lambda c: F.when(
            F.startswith(c, F.lit('"')),
            F.replace(
                F.regexp_replace(
                    c, F.lit(r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'), F.lit("$1$2")
                ),
                F.lit('""'), F.lit('"'),
            ),
        ).otherwise(c),
    )


def split_records(text: Column) -> Column:
    """Records of a CSV text; empty lines are none."""
    return F.filter(F.regexp_extract_all(text, F.lit(_CSV_RECORD), F.lit(0)), lambda r: r != "")


def header_cells(record: Column) -> Column:
    return F.transform(cells(record), strip)


def rows_from_text(df: DataFrame, raw: str = "raw") -> DataFrame:
    """CSV documents in a text column: a row per CSV row, as ``_header`` and ``_cells``.

    Every document carries its own header, so documents with different headers
    mix freely.  The document's other columns are repeated on its rows; ``raw``
    becomes the text of the row.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != raw]
    records = df.select(*others, split_records(strip(F.col(raw))).alias("_records"))
    # Only the header goes along to the rows.  Both stand in one struct that a generator makes, so that Spark can't
    # move the header's expression, and with it all of the records, behind the generator of the rows.
    apart = F.struct(
        header_cells(F.get("_records", F.lit(0))).alias("_header"),
        F.slice("_records", 2, F.greatest(F.size("_records") - 1, F.lit(0))).alias("_below"),
    )
    documents = records.select(*others, F.inline(F.array(apart)))
    rows = documents.select(*others, "_header", F.posexplode_outer("_below").alias("_place", raw))
    return rows.withColumn("_cells", cells(F.col(raw)))


def rows_from_records(records: DataFrame, raw: str = "raw") -> DataFrame:
    """The same of records that carry their file's ``_header``."""
    return records.withColumn("_cells", cells(F.col(raw)))


def rows_from_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """The same of lines.  A line with an open quote has no cells and fails."""
    quotes = F.length(raw) - F.length(F.replace(F.col(raw), F.lit('"')))
    return lines.withColumn("_cells", F.when(quotes % 2 == 0, cells(F.col(raw))))


def _canonical_from_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Canonical columns of a table read with its header; no data is scanned for it."""
    csv_columns = [c for c in df.columns if c not in keep]
    source = resolve_columns([c for c in csv_columns if c != EXTRA_CELL])

    def cell(name: str) -> str:
        column = source[name]
        text = "''" if column is None else f"coalesce(CAST(`{column}` AS STRING), '')"
        return f"{sql_strip(text)} AS _c_{name}"

    too_long = f"{EXTRA_CELL} IS NOT NULL" if EXTRA_CELL in csv_columns else "FALSE"
    record = ", ".join(f"`{c}`" for c in csv_columns)
    return df.selectExpr(
        *[f"`{c}`" for c in keep],
        *[cell(name) for name, _ in fixed.WINDOWS_COLUMNS],
        f"{too_long} AS _too_long",
        f"to_json(struct({record})) AS _raw",
    )


def _canonical_from_arrays(df: DataFrame, keep: list[str], raw: str) -> DataFrame:
    """Canonical columns of rows that bring their own header array."""

    def cell(name: str, spellings: list[str]) -> str:
        # A header used twice keeps its last column, so the search runs backwards.
        places = [
            f"nullif(array_position(_backwards, {sql_text(s)}), 0)" for s in [*spellings, name]
        ]
        at = f"CAST(size(_header) - coalesce({', '.join(places)}) AS INT)"
        return sql_strip(f"coalesce(get(_cells, {at}), '')") + f" AS _c_{name}"

    fields = [cell(name, spellings) for name, spellings in fixed.WINDOWS_COLUMNS]
    fields.append("coalesce(size(_cells) > size(_header), FALSE) AS _too_long")
    fields.append(f"`{raw}` AS _raw")
    return computed_once(df.withColumn("_backwards", F.reverse("_header")), keep, fields)


def normalize_wel(
    df: DataFrame,
    keep: list[str] | None = None,
    raw: str = "raw",
    path_style: str = "any",
) -> DataFrame:
    """Events of Windows Event Log rows.

    ``df`` is either a table with the CSV columns, of which ``keep`` names those
    to carry along, or the result of :func:`rows_from_text`.  A row without a
    usable event code, or with more cells than the header, is ``failed``.
    """
    if "_cells" in df.columns:
        keep = kept_columns(df, "_cells", "_header")
        rows = _canonical_from_arrays(df, keep, raw)
    else:
        keep = list(keep or [])
        if EVENT_ID in df.columns and EVENT_ID not in keep:
            keep.append(EVENT_ID)
        kept_columns(df.select(*[F.col(f"`{c}`") for c in keep]))
        rows = _canonical_from_columns(df, keep)
    c = {name: F.col("_c_" + name) for name, _ in fixed.WINDOWS_COLUMNS}
    coded = rows.withColumn(
        "_event_code", F.coalesce(whole_number(c["eventid"]), F.lit(0))
    ).withColumn(
        "_account", F.when(c["targetuser"] != "", c["targetuser"]).otherwise(c["subjectuser"])
    )
    known = with_event_meaning(coded, "_event_code")
    code, account = F.col("_event_code"), F.col("_account")
    usable = (code != 0) & ~F.col("_too_long")
    return shape_event(
        known,
        "wel",
        {
            "event.created": c["timecreated"],
            "event.category": F.array("_category"),
            "event.type": F.col("_types"),
            "event.action": F.when(
                code.isin(4624, 4625) & (c["logontype"] != ""),
                F.concat("_action", F.lit(" ("), logon_type_name(c["logontype"]), F.lit(")")),
            ).otherwise(F.col("_action")),
            "event.outcome": F.col("_outcome"),
            "event.severity": F.col("_severity"),
            "event.original_event_id": code.cast("string"),
            "host.name": c["computername"],
            "host.os.type": F.lit("windows"),
            "process.pid": whole_number(c["processid"]),
            "process.name": base_name(c["process"], path_style),
            "process.executable": c["process"],
            "process.command_line": c["cmdline"],
            "process.parent.name": base_name(c["parentproc"], path_style),
            "process.parent.executable": c["parentproc"],
            "network.source.ip": F.when(~code.isin(4688, 4689), c["ipaddress"]),
            "user.name": account_name(account),
            "user.domain": account_domain(account),
            "log.source_tool": F.lit("windows-event-log"),
            "log.original_log": F.create_map(
                F.lit("EventID"), c["eventid"],
                F.lit("TimeCreated"), c["timecreated"],
                F.lit("Computer"), c["computername"],
                F.lit("Message"), c["message"],
            ),
            "tags": empty_strings(),
        },
        status=F.when(usable, "ok").otherwise("failed"),
        error=F.when(F.col("_too_long"), "more cells than header").when(
            code == 0, "no event code"
        ),
        keep=keep,
        raw=F.col("_raw"),
    )
