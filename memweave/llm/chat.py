r"""Chat formatting: typed content parts are flattened into one marked-up text with a loss mask.

A turn is ``<|turn|>role<|text|>content</s>``. Content is a list of typed parts; a visitor renders text
parts as they are and image, audio and document parts as numbered placeholders such as ``<|image:0|>``,
and records what each refers to and how many tokens it stands for. Control strings inside texts (those of
this template and the usual ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first
character, one more if they have some already, which reading back removes. The loss mask covers the
content of assistant turns, in characters of the formatted text.

Turns stream through sorted partitions: a conversation of any length needs no more memory than a batch.
Defined results: null text is an empty text part; a null role is empty; turns that tie go by role, then
text; a null conv_id is a conversation of its own; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(?=\|(?:turn|text|(?:image|audio|document):\d+)\|>|/?s>|/?INST\])")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
#: Tokens that stand for an image tile, a second of audio and a page.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 25, 600
PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
FORMATTED = "conv_id bigint, turn bigint, seq bigint, formatted string, loss_start bigint, loss_end bigint, attachments array<struct<kind: string, ref: string, tokens: bigint>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][:-1] if m[2] else m[0], text)


@dataclass
class Flattener:
    """Visits parts in order; placeholders are numbered through a turn."""

    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        kind = part.get("kind") or "text"
        visit = getattr(self, f"visit_{kind}", None)
        if visit is None:
            raise ValueError(f"unknown content part: {kind}")
        return visit(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        tiles = math.ceil((part.get("width") or TILE) / TILE) * math.ceil((part.get("height") or TILE) / TILE)
        return self._attach("image", part, tiles * TILE_TOKENS)

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, math.ceil((part.get("seconds") or 0) * SECOND_TOKENS))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, (part.get("pages") or 1) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}:{len(self.attachments) - 1}|>"


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, list[dict]]:
    """(formatted, start and end of the content, attachments) of one turn."""
    visitor = Flattener()
    head = TURN + escape(role or "") + TEXT
    whole: list[dict] = []
    for p in parts or []:  # neighbouring texts are one, lest a control string stand across their border
        if whole and all((q.get("kind") or "text") == "text" for q in (p, whole[-1])):
            whole[-1] = whole[-1] | {"text": (whole[-1].get("text") or "") + (p.get("text") or "")}
        else:
            whole.append(p)
    body = "".join(map(visitor.visit, whole))
    return head + body + END, len(head), len(head) + len(body), visitor.attachments


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn of a formatted text, unescaped; placeholders stay."""
    found = []
    for turn in formatted.split(TURN)[1:]:
        role, _, body = turn.partition(TEXT)
        if not body.endswith(END):
            raise ValueError("a turn without its end")
        found.append((unescape(role), unescape(body[: -len(END)])))
    return found


def with_text_parts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts: each text as one part."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.array(part).cast(PARTS).alias("parts"))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, seq, offset = object(), 0, 0
    for batch in batches:
        out = {n: [] for n in ("seq", "formatted", "loss_start", "loss_end", "attachments")}
        rows = (batch.column(n).to_pylist() for n in ("conv_id", "role", "parts"))
        for conv, role, parts in zip(*rows, strict=True):
            if conv != last:
                last, seq, offset = conv, 0, 0
            text, begin, end, attached = format_turn(role, parts)
            loss = role == "assistant"
            for n, v in zip(out, (seq, text, offset + begin if loss else None, offset + end if loss else None, attached), strict=True):
                out[n].append(v)
            seq, offset = seq + 1, offset + len(text)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))
        yield pa.record_batch({"conv_id": batch.column("conv_id"), "turn": batch.column("turn")} | {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts) -> one row for each turn, in order within the partition of its conversation.

    The conversation's formatted text is its turns' ``formatted`` in order of ``seq``; loss_start and loss_end are offsets
    in that text, null outside the loss mask.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))
    return ordered.mapInArrow(_format, FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens")
    state: list | None = None

    def row() -> list:
        return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]]

    for batch in batches:
        done = []
        rows = (batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end", "attachments"))
        for conv, text, begin, end, attached in zip(*rows, strict=True):
            if state is None or conv != state[0]:
                if state is not None:
                    done.append(row())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, body in read_turns(text):
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode())
            if begin is not None:
                masked = unescape(text[begin - state[5] : end - state[5]])
                state[3] += len(masked)
                state[4].update(masked.encode())
            state[5] += len(text)
            state[6] += len(attached)
            state[7] += sum(a["tokens"] for a in attached)
        yield _rows(names, done)
    if state is not None:
        yield _rows(names, [row()])


def _rows(names: tuple[str, ...], rows: list[list]) -> pa.RecordBatch:
    kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string()}
    return pa.record_batch({n: pa.array([r[i] for r in rows], kinds.get(n, pa.int64())) for i, n in enumerate(names)})


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read from ``format_conversations``' rows as they stand."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"
    return formatted.mapInArrow(_digest, schema)


def format_report(turns: DataFrame) -> DataFrame:
    """Digests of all conversations and of number -7, whose two turns quote control strings."""
    tricky = turns.sparkSession.createDataFrame([(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(with_text_parts(turns).unionByName(with_text_parts(tricky))))
