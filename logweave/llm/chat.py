"""Chat formatting with typed content parts.

A turn's parts (text, image, audio, document) are flattened by a visitor into the text of one segment:
``<|im_start|>role\\n ... <|im_end|>\\n``.  Texts are escaped so that no control string can come from
them, nor from neighbouring texts together, which are escaped as one; the other parts become numbered placeholders, with their references and the tokens that they will
expand to.  Assistant texts are under the loss mask, as spans of code points of the segment.

Segments are rows, ordered by conversation and turn, so a conversation with a third of all turns is spread
like any other.  Only its digest reads its turns one after the other, as a stream with a state of constant size.

* A null role or text counts as empty; a null ``conv_id`` is a conversation of its own; null turns come first.
* A part of a type that no method visits is an attachment of kind ``other`` without tokens; a null type is text.
* Turns that tie are ordered by role, then text; repeated rows are turns of their own.
* An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import common

START, END = "<|im_start|>", "<|im_end|>"
PART = ("struct<type: string, text: string, ref: string, width: int, height: int, "
        "seconds: double, pages: int>")
SEGMENTS = ("conv_id bigint, turn bigint, segment string, "
            "loss array<struct<begin: int, stop: int>>, "
            "attachments array<struct<kind: string, ref: string, position: int, tokens: int>>, "
            "attached_tokens bigint")

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One more backslash between ``<`` and ``|``: the result has no control string."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role fits in one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Visitor:
    """Flattens the parts of one turn, in order."""

    def __init__(self, trained: bool, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 256):
        self.trained, self.patch, self.audio_rate, self.page_tokens = trained, patch, audio_rate, page_tokens
        self.out: list[str] = []
        self.texts: list[str] = []
        self.length = 0
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def end_text(self) -> None:
        """Neighbouring texts are escaped together: marks could arise where they meet."""
        if not self.texts:
            return
        begin = self.length
        self.put(escape("".join(self.texts)))
        self.texts = []
        if self.trained:
            self.loss.append({"begin": begin, "stop": self.length})

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.end_text()
        self.attachments.append(
            {"kind": kind, "ref": part.get("ref"), "position": self.length, "tokens": tokens}
        )
        self.put(f"<|{kind}:{len(self.attachments) - 1}|>")

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or 1) / self.patch) for k in ("width", "height"))
        self.attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 1) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        self.attach("other", part, 0)


def text_part(text: Column) -> Column:
    """A plain text as the one part of a turn."""
    fields = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    kinds = {"type": "string", "text": "string", "ref": "string", "width": "int", "height": "int",
             "seconds": "double", "pages": "int"}
    return F.array(F.struct(*[fields.get(k, F.lit(None)).cast(v).alias(k) for k, v in kinds.items()]))


def format_turns(turns: DataFrame) -> DataFrame:
    """Segments of ``conv_id, turn, role, parts``; each turn by itself."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()),
        ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))),
        ("attachments", pa.list_(pa.struct([
            ("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int32()),
        ]))),
        ("attached_tokens", pa.int64()),
    ])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                role = row["role"] or ""
                seen = Visitor(trained=role == "assistant")
                seen.put(f"{START}{escape_role(role)}\n")
                for part in row["parts"] or []:
                    seen.visit(part or {})
                seen.end_text()
                seen.put(f"{END}\n")
                rows.append({
                    "conv_id": row["conv_id"], "turn": row["turn"], "segment": "".join(seen.out),
                    "loss": seen.loss, "attachments": seen.attachments,
                    "attached_tokens": sum(a["tokens"] for a in seen.attachments),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return turns.select("conv_id", "turn", "role", "parts").transform(common.arrow_map, render, SEGMENTS)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment as they were before formatting."""
    if not (segment.startswith(START) and segment.endswith(f"{END}\n")):
        raise ValueError("a segment without its marks")
    role, _, body = segment[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments in order.

    Sorted by Spark (which spills), then read as a stream: the state is two hash objects and three counts.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> dict:
            turns, loss, n, chars, total = state
            return {"conv_id": now[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                    "loss_sha256": loss.hexdigest(), "formatted_chars": total}

        for batch in batches:
            done = []
            for conv, segment, spans in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss")],
                                            strict=True):
                if now != (conv,):
                    if state:
                        done.append(row())
                    now, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                role, text = parse(segment)
                state[0].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    masked = unescape(segment[span["begin"] : span["stop"]])
                    state[1].update(masked.encode())
                    state[3] += len(masked)
                state[2] += 1
                state[4] += len(segment)
            yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema)

    return (
        segments.select("conv_id", "turn", "segment", "loss")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
        .transform(common.arrow_map, read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                          "loss_sha256 string, formatted_chars bigint")
    )


def format_and_read(conversations: DataFrame) -> DataFrame:
    """Formats plain conversations, writes the segments and reads them back."""
    turns = conversations.withColumn("parts", text_part(F.col("text")))
    return digests(common.written(format_turns(turns), "chat-segments"))
