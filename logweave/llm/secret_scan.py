"""Secrets in texts: a trigram index picks the rows that a rule can match, regular expressions verify.

The postings (trigram, row) hold the trigrams that the rules' Boolean queries name, over all
texts.  They are intersected per rule and row; the rows that remain, and for rules without a mandatory trigram all
rows, are matched.  Only built-in functions are used.

* Spans are code points, end exclusive; matches are leftmost and don't overlap within a kind; a match that is
  shorter than its rule demands is dropped after matching.
* Null texts count as empty.  Repeated rows are scanned alike; rows are told apart by id and a hash of the text, so ids may repeat or be null.
* An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import common, trigrams


@dataclass(frozen=True)
class Rule:
    """``pattern`` means the same to Java and to Python; ``folds``: the index is asked in lower case."""

    kind: str
    pattern: str
    folds: bool = False
    group: int = 0
    least: int = 1  # characters of the group; shorter matches are dropped


#: Stands for a null id in joins.
NO_ID = (1 << 63) - 1

#: The base kinds, in their order.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         folds=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # Runs are maximal, so asking for 24 at once finds the same as dropping shorter runs.
    Rule("hex", r"[0-9a-f]{24,}", least=24),
]
#: Added kinds.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
]
RULES = BASE + MORE


def postings(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, tag, trigram: which of the trigrams that the rules need stand in which row."""
    text = F.col("text")
    wanted = {False: set(), True: set()}
    for rule in rules:
        for conjunction in trigrams.query(rule.pattern, rule.folds) or []:
            wanted[rule.folds] |= conjunction
    found = [
        F.when(F.contains(F.col("folded" if folds else "plain"), F.lit(t)), F.lit(("f" if folds else "p") + t))
        for folds, needed in wanted.items() for t in sorted(needed)
    ]
    return (
        documents.select("doc_id", "tag", text.alias("plain"), F.lower(text).alias("folded"))
        .select("doc_id", "tag", F.explode(F.array_compact(F.array(*found))).alias("trigram"))
    )


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, tag and the kinds whose Boolean query its postings meet."""
    has = index.groupBy("doc_id", "tag").agg(F.collect_set("trigram").alias("has"))
    holds = []
    for rule in rules:
        query = trigrams.query(rule.pattern, rule.folds)
        if query is None:
            continue
        sign = "f" if rule.folds else "p"
        met = F.lit(False)
        for conjunction in query:
            terms = [sign + t for t in sorted(conjunction)]
            met = met | (F.size(F.array_intersect("has", F.array(*map(F.lit, terms)))) == len(terms))
        holds.append(F.when(met, F.lit(rule.kind)))
    kinds = F.array_compact(F.array(*holds))
    return has.select("doc_id", "tag", kinds.alias("kinds")).filter(F.size("kinds") > 0)


#: Matches that one running sum steps over; sums of blocks of so many are then summed in turn.
BLOCK = 128


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(steps: Column) -> Column:
    """The sums of all steps before each one (array<int>)."""
    return F.aggregate(
        steps, F.array(F.lit(0)),
        lambda sums, step: F.concat(sums, F.array(F.element_at(sums, -1) + step)),
    )


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, kind order, end>> of a rule.

    The pieces between matches and the matches alternate, so lengths give positions: sums run inside blocks of
    ``BLOCK`` matches, then over the blocks, so a text's work is in proportion to its matches.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = found if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.transform(
        F.arrays_zip(found.alias("found"), value.alias("value"), F.split(text, rule.pattern, -1).alias("gap")),
        lambda p: F.struct(
            F.char_length(p["gap"]).alias("gap"),
            F.coalesce(F.char_length(p["found"]), F.lit(0)).alias("found"),
            F.coalesce(F.char_length(p["value"]), F.lit(-1)).alias("value"),
        ),
    )

    def in_block(block: Column) -> Column:
        """The block's length, and its spans counted from its own start."""
        before = _running(F.transform(block, lambda p: p["gap"] + p["found"]))
        return _bound(before, lambda sums: F.struct(
            F.element_at(sums, -1).alias("length"),
            F.filter(
                F.zip_with(block, F.slice(sums, F.lit(1), F.size(block)), lambda p, at: F.struct(
                    (at + p["gap"]).alias("start"), F.lit(order).alias("kind"),
                    (at + p["gap"] + p["found"]).alias("end"), p["value"].alias("value"),
                )),
                lambda s: s["value"] >= rule.least,
            ).alias("spans"),
        ))

    def whole(parts: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda k: _bound(F.slice(parts, k, F.lit(BLOCK)), in_block))
        return _bound(blocks, lambda done: F.flatten(F.zip_with(
            done, F.slice(_running(F.transform(done, lambda b: b["length"])), F.lit(1), F.size(done)),
            lambda b, at: F.transform(b["spans"], lambda s: F.struct(
                (s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"))),
        )))

    return _bound(parts, whole)


def scan(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and ``found``: array<struct<start, kind, end>>, sorted; ``kind`` numbers the rules.

    Rules without a trigram query run where the texts are read.  For the others only the texts of candidate
    rows move; their spans, a few numbers a row, are joined to the rest.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")
    )
    open_rules = {k for k, r in enumerate(rules) if trigrams.query(r.pattern, r.folds) is None}
    index = common.written(postings(rows, rules), "secret-postings")
    picked = common.written(candidates(index, rules), "secret-candidates")
    verified = [
        F.when(F.array_contains("kinds", rule.kind), _spans(rule, k, F.col("text"))).otherwise(none)
        for k, rule in enumerate(rules) if k not in open_rules
    ]
    hits = (
        common.written_matches(rows, picked, ["doc_id", "tag"], "secret-texts")
        .select("doc_id", "tag", F.concat(*verified).alias("picked_found"))
        .filter(F.size("picked_found") > 0).dropDuplicates(["doc_id", "tag"])
    )
    scanned = [
        F.when(F.col("text").rlike(rules[k].pattern), _spans(rules[k], k, F.col("text"))).otherwise(none)
        for k in sorted(open_rules)
    ]
    everywhere = rows.select("doc_id", "tag", F.concat(none, *scanned).alias("open_found"))
    return everywhere.join(hits, ["doc_id", "tag"], "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        F.array_sort(F.concat("open_found", F.coalesce("picked_found", none))).alias("found"),
    )


def joined(found: Column, rules: list[Rule] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
        )), ",",
    )


def report(documents: DataFrame) -> DataFrame:
    """The spans of all rules with counts and a digest of the base ones."""
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return scan(documents).select(
        "doc_id",
        *[count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
