"""Text helpers: every function takes and returns Columns, JVM-side only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.fixed_values import WHITE_SPACE


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_strip(expression: str) -> str:
    """:func:`strip` of a SQL expression."""
    return f"btrim({expression}, {sql_text(WHITE_SPACE)})"


def strip(value: Column) -> Column:
    """Trim every kind of white space; ``trim`` alone only knows the blank."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def null_to_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def whole_number(value: Column) -> Column:
    """Whole-number text as BIGINT, NULL for anything else (also too many digits).

    Blank text is common and never reaches the cast, which would raise and catch.
    """
    digits = strip(value)
    return F.when(digits != "", digits.try_cast("bigint"))


def base_name(path: Column, path_style: str = "any") -> Column:
    """Last path part.  ``path_style='posix'`` splits at ``/`` only."""
    slashed = path if path_style == "posix" else F.translate(path, "\\", "/")
    return F.substring_index(slashed, "/", -1)


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")


def account_domain(account: Column) -> Column:
    """Part before the first backslash, blank without one."""
    return F.when(
        F.contains(account, F.lit("\\")), F.substring_index(account, "\\", 1)
    ).otherwise("")


def account_name(account: Column) -> Column:
    """Part after the first backslash, everything without one."""
    cut = F.instr(account, "\\")
    return F.when(cut > 0, F.substring(account, cut + 1, F.length(account))).otherwise(account)


def hash_value(hashes: Column, name_pattern: str) -> Column:
    """Last ``NAME=value`` of a comma list, lower case, blank when absent."""
    hits = F.regexp_extract_all(
        hashes, F.lit(rf"(?i)(?:^|,)\s*(?:{name_pattern})\s*=([^,]*)"), F.lit(1)
    )
    return F.lower(strip(null_to_blank(F.try_element_at(hits, F.lit(-1)))))


def md5_of(hashes: Column) -> Column:
    return hash_value(hashes, "MD5")


def sha256_of(hashes: Column) -> Column:
    return hash_value(hashes, "SHA-?256")


def technique_tags(rule_name: Column) -> Column:
    """Technique ids of a ``technique_id=T1059,technique_name=x`` rule name."""
    parts = F.filter(
        F.split(rule_name, ","), lambda p: F.contains(F.lower(p), F.lit("technique_id="))
    )
    ids = F.transform(
        parts, lambda p: strip(F.substring(p, F.instr(p, "=") + 1, F.length(p)))
    )
    return F.when(
        F.contains(rule_name, F.lit("=")), F.filter(ids, lambda t: t != "")
    ).otherwise(empty_strings())


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def contains_any(value: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(value, F.lit(word))
    return found


def like_term(term: str) -> str:
    r"""A LIKE pattern matching the term anywhere; ``%`` and ``_`` stay wildcards.

    A backslash escapes the character after it.  Spark only accepts that before
    ``%``, ``_`` and a backslash, so before any other character it is dropped.
    """
    kept: list[str] = []
    rest = iter("%" + term + "%")
    for char in rest:
        if char == "\\":
            escaped = next(rest)
            kept.append("\\" + escaped if escaped in "%_\\" else escaped)
        else:
            kept.append(char)
    if len(kept) > 1 and kept[-1] == "\\\\":
        kept.append("%")
    return "".join(kept)


def one_line_groups(value: Column, alternatives: Iterable[tuple[str, int]]) -> Column:
    r"""All capture groups of the first alternative found in a one-line text.

    Each alternative is ``(pattern, number of groups)`` and may match anywhere;
    they are tried in order over the whole text.  The result is an array whose
    element ``i`` is group ``i`` over all alternatives (blank if it took no part)
    and which has a single element when nothing matched.  One regex pass yields
    every group, because a line cannot hold the ``\n`` put between the groups.
    """
    patterns, groups = [], 0
    for pattern, count in alternatives:
        patterns.append(".*?" + pattern)
        groups += count
    regex = "(?Ud)^(?:" + "|".join(patterns) + ").*$"
    # The leading marker makes element 0 blank, so group i sits at index i.
    marker = "".join(f"\n${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(value, F.lit(regex), F.lit(marker)), "\n")
