"""CEF lines and generic JSON objects: one record per line or object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import fixed_values as fixed
from logweave.functions.shape import computed_once, kept_columns, shape_event
from logweave.functions.text import (
    contains_any,
    empty_strings,
    null_to_blank,
    sql_strip,
    sql_text,
    strip,
    whole_number,
)

_HEADER_CELLS = ("vendor", "product", "version", "sig_id", "name", "severity", "extensions")


def header_severity(severity: Column) -> Column:
    """CEF severity 0-10 on the scale of 0 to 100; text counts as 0."""
    number = F.coalesce(whole_number(severity), F.lit(0).cast("bigint"))
    # Beyond 10 the result is 100 anyway, so long digit runs cannot overflow.
    return F.least(number, F.lit(10)) * 10


# A key is a whole word before ``=``; white space around key and sign is no value.
_KEY = r"(?U)(?<!\w)(\w+)="
_KEY_AND_SPACE = r"(?U)[\s\x1c-\x1f]*(?<!\w)\w+=[\s\x1c-\x1f]*"


def extension_keys(extensions: Column) -> Column:
    """The keys of CEF extension text, in order, with repeats."""
    return F.regexp_extract_all(extensions, F.lit(_KEY), F.lit(1))


def extension_values(extensions: Column) -> Column:
    """The trimmed values of CEF extension text; each runs to the next key."""
    # What stands before the first key belongs to none.
    pieces = F.split(strip(extensions), _KEY_AND_SPACE)
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def extension_pairs(extensions: Column) -> Column:
    """``ARRAY<STRUCT<key, value>>`` of CEF extension text."""
    keys = extension_keys(extensions).alias("key")
    return F.arrays_zip(keys, extension_values(extensions).alias("value"))


def _as_dictionary(df: DataFrame) -> DataFrame:
    """Keep the place of a repeated key's first pair and the value of its last."""
    keys, values = F.col("_keys"), F.col("_values")
    single = F.size(F.array_distinct(keys)) == F.size(keys)

    def last_value(key: Column) -> Column:
        back = F.array_position(F.reverse(keys), key).cast("int")
        return F.get(values, F.size(keys) - back)

    return df.withColumn(
        "_values",
        F.when(single, values).otherwise(F.transform(F.array_distinct(keys), last_value)),
    ).withColumn("_keys", F.when(single, keys).otherwise(F.array_distinct(keys)))


def outcome_of(word: Column) -> Column:
    lowered = F.lower(word)
    return (
        F.when(lowered.isin(fixed.SUCCESS_WORDS), "success")
        .when(lowered.isin(fixed.FAILURE_WORDS), "failure")
        .otherwise("unknown")
    )


def keyword_category(text: Column, has_address: Column) -> Column:
    """Category and type by the first keyword list with a word in the text."""
    lowered = F.lower(text)
    result = None
    for category, kind, words in fixed.KEYWORD_CATEGORIES:
        if kind == "connection":
            kind_column = F.when(has_address, kind).otherwise("info")
        else:
            kind_column = F.lit(kind)
        meaning = F.struct(F.lit(category).alias("category"), kind_column.alias("kind"))
        hit = contains_any(lowered, words)
        result = F.when(hit, meaning) if result is None else result.when(hit, meaning)
    return result.otherwise(
        F.struct(
            F.when(has_address, "network").otherwise("process").alias("category"),
            F.lit("info").alias("kind"),
        )
    )


def parse_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``_format`` (cef, json or NULL), the CEF header cells, ``_keys, _values``."""
    line = strip(F.col(raw))
    formatted = df.withColumn("_line", line).withColumn(
        "_format",
        F.when(F.upper(F.substring("_line", 1, 4)) == "CEF:", "cef").when(
            F.startswith("_line", F.lit("{")), "json"
        ),
    )
    is_cef, is_json = F.col("_format") == "cef", F.col("_format") == "json"
    # Parsed inside brackets, text after the object is an error and not ignored.
    boxed = F.concat(F.lit("["), F.col("_line"), F.lit("]"))
    split = formatted.withColumn(
        "_cells", F.when(is_cef, F.split("_line", r"\|", 8))
    ).withColumn(
        "_objects", F.when(is_json, F.from_json(boxed, "array<map<string,string>>"))
    )
    header_ok = (F.size("_cells") == 8) & F.get("_cells", F.lit(0)).rlike(r"(?iU)^CEF:\d+$")
    cells = split.withColumn("_header_ok", F.coalesce(header_ok, F.lit(False))).withColumn(
        "_object", F.when(F.size("_objects") == 1, F.get("_objects", F.lit(0)))
    )
    with_header = cells.select(
        *[F.col(f"`{c}`") for c in df.columns],
        "_format",
        "_header_ok",
        "_object",
        *[
            F.when(F.col("_header_ok"), F.get("_cells", F.lit(i + 1))).alias("_h_" + name)
            for i, name in enumerate(_HEADER_CELLS)
        ],
    )
    from_header, extensions = F.col("_header_ok"), F.col("_h_extensions")
    return _as_dictionary(
        with_header.withColumn(
            "_keys",
            F.when(from_header, extension_keys(extensions)).otherwise(F.map_keys("_object")),
        ).withColumn(
            "_values",
            F.when(from_header, extension_values(extensions)).otherwise(F.map_values("_object")),
        )
    )


def map_fields(df: DataFrame) -> DataFrame:
    """Normalize ``_keys`` and turn both arrays round, so the last pair comes first."""
    # Only JSON knows fields without a value; those feed nothing.
    missing = F.exists("_values", lambda v: v.isNull())
    has_value = lambda _, i: F.get("_values", i).isNotNull()
    filled = df.withColumn(
        "_keys", F.when(missing, F.filter("_keys", has_value)).otherwise(F.col("_keys"))
    ).withColumn(
        "_values", F.when(missing, F.array_compact("_values")).otherwise(F.col("_values"))
    )
    spelled = F.transform("_keys", lambda k: F.translate(F.lower(k), "- ", "__"))
    return filled.withColumn("_keys", F.reverse(spelled)).withColumn(
        "_values", F.reverse("_values")
    )


def field(keys: list[str]) -> str:
    """SQL of the trimmed value of the last pair with one of the keys, or NULL."""
    places = [f"nullif(array_position(_keys, {sql_text(key)}), 0)" for key in keys]
    first = places[0] if len(places) == 1 else f"least({', '.join(places)})"
    value = f"get(_values, CAST({first} AS INT) - 1)"
    return f"CASE WHEN _header_ok THEN {value} ELSE {sql_strip(value)} END"


def normalize_cef(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Events of CEF lines and of generic JSON objects, told apart line by line.

    A CEF line with a short header is ``failed``; broken JSON and any other text
    is ``dropped``.  Both formats share one pass over the input.
    """
    keep = kept_columns(df)
    mapped = map_fields(parse_records(df, raw))
    is_cef = F.col("_header_ok")
    wide = mapped.selectExpr(
        *[f"`{c}`" for c in keep],
        "_format",
        "_header_ok",
        "_object",
        *["_h_" + name for name in _HEADER_CELLS],
        *[f"{field(keys)} AS _f_{name}" for name, keys in fixed.FIELD_ALIASES],
    )
    f = {name: F.col("_f_" + name) for name, _ in fixed.FIELD_ALIASES}
    h = {name: null_to_blank(F.col("_h_" + name)) for name in _HEADER_CELLS}
    own_severity = F.nullif(whole_number(f["severity"]), F.lit(0).cast("bigint"))
    staged = wide.withColumn(
        "_action", F.when(f["action"] != "", f["action"]).otherwise(h["name"])
    ).withColumn(
        "_class",
        keyword_category(
            F.concat_ws(" ", h["vendor"], h["product"], F.col("_action")),
            (null_to_blank(f["src_ip"]) != "") | (null_to_blank(f["dst_ip"]) != ""),
        ),
    )
    made = [c for c in staged.columns if c not in keep]
    staged = computed_once(staged, keep, made)
    text = lambda key: F.lit(key)
    ok = is_cef | F.col("_object").isNotNull()
    return shape_event(
        staged,
        "cef",
        {
            "event.created": null_to_blank(f["created"]),
            "event.category": F.array("_class.category"),
            "event.type": F.array("_class.kind"),
            "event.action": F.col("_action"),
            "event.outcome": outcome_of(f["outcome"]),
            "event.severity": F.when(
                is_cef, F.least(F.coalesce(own_severity, header_severity(h["severity"])), F.lit(100))
            ).otherwise(F.coalesce(own_severity, F.lit(0))),
            "event.original_event_id": h["sig_id"],
            "host.name": f["host_name"],
            "process.pid": whole_number(f["process_pid"]),
            "process.name": f["process_name"],
            "process.command_line": f["command_line"],
            "network.transport": F.lower(f["transport"]),
            "network.destination.ip": f["dst_ip"],
            "network.destination.port": whole_number(f["dst_port"]),
            "network.destination.domain": f["dst_domain"],
            "network.source.ip": f["src_ip"],
            "network.source.port": whole_number(f["src_port"]),
            "file.path": f["file_path"],
            "file.name": f["file_name"],
            "file.hash.sha256": F.when(~is_cef, f["file_sha256"]),
            "user.name": f["user_name"],
            "log.source_tool": F.when(
                is_cef, F.btrim(F.concat_ws("/", h["vendor"], h["product"]), F.lit("/"))
            ).otherwise("generic-json"),
            "log.original_log": F.when(
                is_cef,
                F.create_map(
                    text("vendor"), h["vendor"],
                    text("product"), h["product"],
                    text("sig_id"), h["sig_id"],
                    text("name"), h["name"],
                    text("raw_severity"), h["severity"],
                ),
            ).otherwise(F.col("_object")),
            "tags": empty_strings(),
        },
        status=F.when(ok, "ok").when(F.col("_format") == "cef", "failed").otherwise("dropped"),
        error=F.when(~ok & (F.col("_format") == "cef"), "short CEF header")
        .when(~ok & (F.col("_format") == "json"), "broken JSON")
        .when(~ok, "neither CEF nor JSON"),
        keep=keep,
        raw=F.col(raw),
    )


def normalize_json(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Events of generic JSON objects; CEF lines among them are read as well."""
    return normalize_cef(df, raw)
