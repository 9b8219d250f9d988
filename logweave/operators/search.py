"""Listing, searching and paging stored events and sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.functions.fixed_values import DEFAULT_PAGE_ROWS
from logweave.functions.text import like_term
from logweave.operators.flat import LISTING_COLUMNS, SEARCHED_COLUMNS

# Blocks that a page is looked for in, coarse to fine: day, minute and instant of the load, then ranges of ids.
# Each holds at most some ten thousand of the next.
_TIME_BLOCKS = (10, 16, 64)
_ID_BLOCKS = (2, 4)


def conditions(
    source_type: str = "", host_name: str = "", search: str = "", session_id: str = "",
    since: str | None = None, until: str | None = None,
) -> list[Column]:
    """The conditions of the filters that are set; events from ``since`` on, and before ``until``."""
    found = []
    if since is not None:
        found.append(F.col("event.created_ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        found.append(F.col("event.created_ts") < F.lit(until).cast("timestamp"))
    if source_type:
        found.append(F.col("source_type") == source_type)
    if host_name:
        found.append(F.col("host_name").like(like_term(host_name)))
    if session_id:
        found.append(F.col("session_id") == session_id)
    if search:
        term = like_term(search)
        found.append(reduce(lambda a, b: a | b, [F.col(c).like(term) for c in SEARCHED_COLUMNS]))
    return found


def find_events(
    table: DataFrame,
    source_type: str = "",
    host_name: str = "",
    search: str = "",
    session_id: str = "",
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Stored events that meet every filter set; all of them when none is."""
    return reduce(
        DataFrame.filter, conditions(source_type, host_name, search, session_id, since, until), table
    )


def listing(table: DataFrame) -> DataFrame:
    """The 13 listed columns, without the event itself."""
    return table.select(*LISTING_COLUMNS)


def page_limits(page: int, per_page: int) -> tuple[int, int]:
    """Offset and number of rows of a page; both numbers count from one."""
    if page < 1 or per_page < 1:
        raise ValueError(f"pages and their rows count from 1, not {page} and {per_page}")
    return (page - 1) * per_page, per_page


def events_page(
    table: DataFrame, page: int = 1, per_page: int = DEFAULT_PAGE_ROWS
) -> DataFrame:
    """One page of the newest events first, equal load times ordered by id.

    Sorting the whole table, or carrying every row before a far page, would not
    do, so the page is looked for in blocks: rows are counted by day, the days that
    hold the page by minute, and so on down to ranges of ids; only the last blocks'
    rows are sorted.  Every page takes the same steps.  What comes back to
    the driver are the blocks that the page touches, no more than it has rows, and one.
    """
    return page_at(table, *page_limits(page, per_page))


def page_at(table: DataFrame, offset: int, rows: int) -> DataFrame:
    """So many rows from an offset on, in the order of :func:`events_page`."""
    for size in _TIME_BLOCKS:
        block = F.substring("indexed_at", 1, size)
        table, offset = _narrowed(table, {"_time": block}, [F.desc("_time")], offset, rows)
    for size in _ID_BLOCKS:
        blocks = {"_time": F.col("indexed_at"), "_ids": F.substring("event_id", 1, size)}
        table, offset = _narrowed(table, blocks, [F.desc("_time"), F.asc("_ids")], offset, rows)
    ordered = table.orderBy(F.desc("indexed_at"), "event_id")
    return listing(ordered.offset(offset).limit(rows))


def _narrowed(
    table: DataFrame, blocks: dict[str, Column], order: list[Column], offset: int, rows: int
) -> tuple[DataFrame, int]:
    """The blocks of the table that hold rows ``[offset, offset + rows)``, and the offset in them."""
    counts = table.groupBy(*[c.alias(n) for n, c in blocks.items()]).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    touched = touched_blocks(counts, order, offset, rows)
    if not touched:
        return table.limit(0), 0
    if len(blocks) == 1:
        [(name, column)] = blocks.items()
        table = table.filter(column.isin([r[name] for r in touched]))
    else:
        keys = F.struct(*blocks.values())
        wanted = [F.struct(*[F.lit(r[n]).alias(n) for n in blocks]) for r in touched]
        table = table.filter(keys.isin(wanted))
    return table, offset - min(r["_start"] for r in touched)


def touched_blocks(counts: DataFrame, order: list[Column], offset: int, rows: int) -> list[Row]:
    """Blocks (counts with ``_rows``) that hold rows ``[offset, offset + rows)``, with the rows before each."""
    start = F.sum("_rows").over(Window.orderBy(*order)) - F.col("_rows")
    return (
        counts.withColumn("_start", start)
        .filter((F.col("_start") < offset + rows) & (F.col("_start") + F.col("_rows") > offset))
        .collect()
    )


def page_count(table: DataFrame, per_page: int = DEFAULT_PAGE_ROWS) -> DataFrame:
    """Total rows and pages, at least one page."""
    return pages_of(table.agg(F.count(F.lit(1)).alias("total")), per_page)


def pages_of(total: DataFrame, per_page: int) -> DataFrame:
    rows = page_limits(1, per_page)[1]
    return total.select(
        "total",
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / rows)).alias("pages"),
    )


def get_event(table: DataFrame, event_id: str) -> DataFrame:
    """The event with an id, or nothing."""
    return table.filter(F.col("event_id") == event_id)


def export_events(
    table: DataFrame, session_id: str = "", limit: int | None = None
) -> DataFrame:
    """Events of one session or of all; with a limit the newest ones only."""
    found = find_events(table, session_id=session_id)
    if limit is None:
        return found
    return found.orderBy(F.desc("indexed_at"), "event_id").limit(limit)


def sessions_latest(sessions: DataFrame, limit: int = DEFAULT_PAGE_ROWS) -> DataFrame:
    """The newest sessions first."""
    _, rows = page_limits(1, limit)
    return sessions.orderBy(F.desc("created_at"), "session_id").limit(rows)


def first_event(events: DataFrame) -> DataFrame:
    """The event that comes first by its time, then by its id."""
    return events.filter(F.col("_status") == "ok").orderBy("event.created", "event.id").limit(1)
