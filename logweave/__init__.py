"""Security-log normalization as Spark DataFrame jobs."""

from logweave.functions.shape import configure
from logweave.operators.dispatch import (
    SourceKind,
    normalize,
    normalize_mixed,
    register_source,
    supported_sources,
)
from logweave.schema import SCHEMA_VERSION, event_schema

__all__ = [
    "SCHEMA_VERSION",
    "SourceKind",
    "configure",
    "event_schema",
    "normalize",
    "normalize_mixed",
    "register_source",
    "supported_sources",
]
