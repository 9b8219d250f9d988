"""Choosing the job of a source, event ids, and the accounting of outcomes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import ids
from logweave.functions.shape import (
    EVENT_ID,
    drop_original_log,
    kept_columns,
    shape_event,
    truncate_original_log,
)
from logweave.operators import store
from logweave.sources import records
from logweave.sources.cef import normalize_cef
from logweave.sources.sysmon import normalize_sysmon
from logweave.sources.syslog import normalize_syslog
from logweave.sources.wazuh import normalize_wazuh
from logweave.sources.wel import normalize_wel


@dataclass(frozen=True)
class SourceKind:
    """How one kind of source finds records in a text column and normalizes them."""

    records: Callable[[DataFrame], DataFrame]
    normalize: Callable[[DataFrame], DataFrame]


_SOURCES: dict[str, SourceKind] = {
    "sysmon": SourceKind(records.sysmon_records, normalize_sysmon),
    "wel": SourceKind(records.wel_records, normalize_wel),
    "wazuh": SourceKind(records.wazuh_records, normalize_wazuh),
    "syslog": SourceKind(records.syslog_records, normalize_syslog),
    "cef": SourceKind(records.cef_records, normalize_cef),
}


def supported_sources() -> list[str]:
    return list(_SOURCES)


def register_source(
    name: str,
    normalize_records: Callable[[DataFrame], DataFrame],
    find_records: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Add a kind of source.  Both functions take and return DataFrames."""
    _SOURCES[name.lower()] = SourceKind(find_records or (lambda df: df), normalize_records)


def source_kind(name: str) -> SourceKind:
    kind = _SOURCES.get(name.lower())
    if kind is None:
        raise ValueError(
            f"no job is registered for {name!r}; there are {', '.join(supported_sources())}"
        )
    return kind


def _finished(
    events: DataFrame, original_log: bool, original_log_max_chars: int
) -> DataFrame:
    if not original_log:
        return drop_original_log(events)
    return truncate_original_log(events, original_log_max_chars)


def _with_ids(df: DataFrame, mode: str) -> DataFrame:
    if mode == "stable":
        return ids.with_event_ids(df, EVENT_ID)
    if mode == "random":
        return ids.with_random_ids(df, EVENT_ID)
    if mode == "content":
        return df
    raise ValueError(f"id_mode must be stable, random or content, not {mode!r}")


def normalize(
    df: DataFrame,
    source_type: str,
    documents: bool = True,
    id_mode: str = "stable",
    original_log: bool = True,
    original_log_max_chars: int = 0,
    **options,
) -> DataFrame:
    """Events of a table with a ``raw`` text column, all of one kind of source.

    ``documents``  the texts hold whole documents (False: one record each)
    ``id_mode``    ``stable`` numbers equal records and costs a shuffle of the raw
                   text; ``content`` lets equal records share an id; ``random``
                   draws ids.  An ``event_uid`` column in ``df`` overrides it.
    ``original_log_max_chars``  cuts longer values of the original; 0 keeps them whole
    ``options``    passed to the job of the source, e.g. ``default_year``
    """
    kind = source_kind(source_type)
    found = kind.records(df) if documents else df
    if EVENT_ID not in found.columns:
        found = _with_ids(found, id_mode)
    events = kind.normalize(found, **options)
    return _finished(events, original_log, original_log_max_chars)


def _unknown_source(df: DataFrame) -> DataFrame:
    return shape_event(
        df,
        "unknown",
        {"event.created": F.lit("")},
        status=F.lit("failed"),
        error=F.lit("unknown source type; supported: " + ", ".join(supported_sources())),
        keep=kept_columns(df),
        raw=F.col("raw"),
    )


def normalize_mixed(
    df: DataFrame,
    source_col: str = "source_type",
    documents: bool = True,
    id_mode: str = "stable",
    original_log: bool = True,
    original_log_max_chars: int = 0,
    stage: bool = True,
) -> DataFrame:
    """Events of a table whose rows name their source in ``source_col``.

    One filtered branch per source, united by name.  The table is written by source
    first (``store.stage_by_source``, which a table may have passed already), so the input is read
    once and each branch then reads its own partition only; ``stage=False`` lets every branch scan the input.
    """
    if stage and store.SOURCE_KEY not in df.columns:
        df = store.stage_by_source(df, store.scratch_path(df.sparkSession, "mixed"), source_col)
    key = F.lower(F.col(source_col))
    if store.SOURCE_KEY in df.columns:
        key = F.col(store.SOURCE_KEY)
    carried = [c for c in df.columns if c != store.SOURCE_KEY]
    branches = []
    for name in supported_sources():
        branch = df.filter(key == name).select(*[F.col(f"`{c}`") for c in carried])
        events = normalize(
            branch, name, documents, id_mode, original_log, original_log_max_chars
        )
        branches.append(events.select(*[F.col(f"`{c}`") for c in _order(events, carried)]))
    others = df.filter(key.isNull() | ~key.isin(supported_sources())).select(
        *[F.col(f"`{c}`") for c in carried]
    )
    if id_mode != "content" and EVENT_ID not in others.columns:
        others = _with_ids(others, id_mode)
    unknown = _unknown_source(others)
    branches.append(unknown.select(*[F.col(f"`{c}`") for c in _order(unknown, carried)]))
    return reduce(DataFrame.unionByName, branches)


def _order(events: DataFrame, carried: list[str]) -> list[str]:
    from logweave.schema import EVENT_COLUMNS

    ids_too = [EVENT_ID] if EVENT_ID in events.columns else []
    kept = list(dict.fromkeys([*carried, *ids_too]))
    return [*kept, *EVENT_COLUMNS, "_status", "_error"]


def outcome_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Per key: events, failed and total as the load reports them, dropped apart."""
    status = F.col("_status")
    return events.groupBy(*keys).agg(
        F.count_if(status == "ok").alias("events"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status.isin("ok", "failed")).alias("total"),
        F.count_if(status == "dropped").alias("dropped"),
    )
