"""Chat formatting: typed content parts, marked turns, reversible escaping, loss mask.

A message is a list of typed parts (text, image, audio, document).  ``Flattener`` visits the
parts in order and turns each attachment into a numbered placeholder, recording its
reference and the number of tokens that it stands for.  Turns are framed by control lines;
a backslash put before anything in a text that could be read as a control string (and before
backslashes that lead up to one) makes the frame unambiguous and reversible.  Neighbouring texts are escaped as one, so
a control string can't be split over parts; backslashes before a placeholder are doubled, so an even run of
them stands before a placeholder and an odd one before text that looks like one (``body_parts`` tells them apart).

    ``### <Role>:`` newline, escaped text, newline ``</turn>`` newline

On a DataFrame a message is a row: its parts are the column ``parts`` (see ``PARTS``), or one text part
made from ``text``.  Conversations are dealt by id and sorted, and one ``Flattener`` goes through each, so
placeholders are numbered through a conversation; a conversation of any length needs one row's memory at a time.

Rows of a conversation are ordered by turn, then role, then parts (texts); repeated rows are kept.
Null text counts as empty and a null role as the empty role; null parts count as none, and a part of an unknown
type is a placeholder without tokens.  A null conversation id forms a
conversation of its own.  An empty table gives no rows; extra columns are ignored.
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
from pyspark.sql import types as T

OPEN, CLOSE = "### ", "</turn>"
#: What could be taken for a control string: any run of backslashes, then a marker's start.
_CONTROL = re.compile(r"(\\*)(###|</turn>|<\|)")
_PLACED = re.compile(r"(\\*)(<\|[a-z]+_[0-9]+\|>)")
_ESCAPED = re.compile(r"(\\+)(###|</turn>|<\|)")


def escape(text: str) -> str:
    """Doubles the backslashes before a control string and adds one more."""
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def body_parts(body: str) -> list[tuple[str, str]]:
    """A formatted body as ``("text", text)`` and ``("attachment", placeholder)`` in order; no text is empty."""
    out, at = [], 0
    for m in _PLACED.finditer(body):
        if len(m[1]) % 2:
            continue
        if text := unescape(body[at : m.start(1)]) + m[1][: len(m[1]) // 2]:
            out.append(("text", text))
        out.append(("attachment", m[2]))
        at = m.end()
    return out + [("text", unescape(body[at:]))] * (at < len(body))


def escape_role(role: str) -> str:
    """Roles stand on one line: backslashes, line breaks and colons are spelled out."""
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace(":", "\\c")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "c": ":"}.get(m[1], m[1]), role)


@dataclass
class Attachment:
    kind: str
    reference: str
    placeholder: str
    tokens: int


@dataclass
class Flattener:
    """Visitor over typed parts; placeholders are numbered through a conversation."""

    image_tokens: int = 576
    audio_tokens_per_second: int = 25
    document_tokens_per_page: int = 800
    attachments: list[Attachment] = field(default_factory=list)
    #: Attachments so far, those that were taken away included.
    count: int = 0

    def taken(self) -> list[Attachment]:
        """The attachments since the last call, which are then no longer held."""
        found, self.attachments = self.attachments, []
        return found

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part.get('type')}", self.visit_unknown)(part)

    def flatten(self, parts: list[dict]) -> str:
        out, text = [], []
        for part in parts:
            if part.get("type") == "text":
                text.append(part.get("text") or "")
                continue
            before = escape("".join(text))
            run = len(before) - len(before.rstrip("\\"))
            out += [before, "\\" * run, self.visit(part)]
            text = []
        return "".join([*out, escape("".join(text))])

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        return self._place("image", part, self.image_tokens * max(1, int(part.get("tiles") or 1)))

    def visit_audio(self, part: dict) -> str:
        seconds = float(part.get("seconds") or 0)  # a length that is no number counts as none
        whole = int(1000 * seconds) if math.isfinite(seconds) else 0
        return self._place("audio", part, max(1, -(-whole * self.audio_tokens_per_second // 1000)))

    def visit_document(self, part: dict) -> str:
        return self._place("document", part, self.document_tokens_per_page * max(1, int(part.get("pages") or 1)))

    def visit_unknown(self, part: dict) -> str:
        return self._place("unknown", part, 0)

    def _place(self, kind: str, part: dict, tokens: int) -> str:
        placeholder = f"<|{kind}_{self.count}|>"
        self.count += 1
        self.attachments.append(Attachment(kind, part.get("ref") or "", placeholder, tokens))
        return placeholder


def format_turn(role: str, parts: list[dict], flattener: Flattener | None = None) -> tuple[str, tuple[int, int]]:
    """One framed turn, and where the loss mask lies in it (empty for all but assistants)."""
    body = (flattener or Flattener()).flatten(parts)
    head = f"{OPEN}{escape_role(role)}:\n"
    mask = (len(head), len(head) + len(body)) if role == "assistant" else (len(head), len(head))
    return f"{head}{body}\n{CLOSE}\n", mask


def format_conversation(turns: list[tuple[str, list[dict] | str]]) -> dict:
    """A whole conversation: text, loss mask spans, attachments."""
    flattener, out, spans, at = Flattener(), [], [], 0
    for role, content in turns:
        parts = [{"type": "text", "text": content}] if isinstance(content, str) else content
        text, (start, end) = format_turn(role, parts, flattener)
        if role == "assistant":
            spans.append((at + start, at + end))
        out.append(text)
        at += len(text)
    return {"text": "".join(out), "loss_spans": spans, "attachments": flattener.attachments}


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped; raises on anything that isn't framed."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at) or (head := text.find(":\n", at)) < 0:
            raise ValueError(f"no turn opens at {at}")
        start = head + 2
        if (end := text.find(f"\n{CLOSE}\n", start)) < 0:
            raise ValueError(f"the turn at {at} isn't closed")
        turns.append((unescape_role(text[at + len(OPEN) : head]), unescape(text[start:end])))
        at = end + len(CLOSE) + 2
    return turns


#: The typed parts of a message; fields that a type has no use for are null.
PARTS = "array<struct<type:string,text:string,ref:string,tiles:int,seconds:double,pages:int>>"
ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("reference", pa.string()), ("placeholder", pa.string()), ("tokens", pa.int64())]))


def _has_parts(conversations: DataFrame) -> bool:
    """Whether there is a column of typed parts; one of another type is an extra column."""
    kind = conversations.schema["parts"].dataType if "parts" in conversations.columns else None
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "type" in kind.elementType.names


def with_parts(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, parts``; a table without parts has one text part a row."""
    if _has_parts(conversations):
        held = conversations.schema["parts"].dataType.elementType.names
        fields = [p.split(":") for p in PARTS[len("array<struct<") : -2].split(",")]
        by_name = F.transform("parts", lambda p: F.struct(*[(p[n] if n in held else F.lit(None)).cast(k).alias(n) for n, k in fields]))
        parts = F.coalesce(by_name, F.array().cast(PARTS))
    else:
        parts = F.expr(f"CAST(array(named_struct('type', 'text', 'text', coalesce(text, ''), 'ref', NULL, 'tiles', NULL, 'seconds', NULL, 'pages', NULL)) AS {PARTS})")
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))


def format_rows(conversations: DataFrame) -> DataFrame:
    """Each row as a framed turn: ``formatted``, the mask ``loss_start``, ``loss_end`` and its ``attachments``.

    The text of a conversation is its rows' ``formatted`` in the order in which they come out.
    """
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    names = ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flattener = object(), Flattener()
        for batch in frames:
            made = []
            for conv_id, role, parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if conv_id != now:
                    now, flattener = conv_id, Flattener()
                before = flattener.count
                text, (start, end) = format_turn(role, parts, flattener)
                made.append((text, start, end, [vars(a) for a in flattener.taken()] if flattener.count > before else []))
            columns = list(zip(*made)) or [[]] * 4
            types = [pa.string(), pa.int64(), pa.int64(), ATTACHMENTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    attachments = "array<struct<kind:string,reference:string,placeholder:string,tokens:bigint>>"
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, formatted string, loss_start bigint, loss_end bigint, attachments {attachments}"
    rows = with_parts(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    return rows.mapInArrow(run, schema)


class _Reader:
    """Running digests of one conversation, read back from its formatted turns."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.attachments, self.tokens = 0, 0

    def add(self, formatted: str, start: int, end: int, attachments: list[dict]) -> None:
        self.attachments += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if end > start:
            masked = unescape(formatted[start:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attachments, self.tokens


def digest_conversations(conversations: DataFrame) -> DataFrame:
    """One row a conversation, read back from the formatted turns.

    ``n_attachments`` and ``attachment_tokens`` are of its parts that aren't text.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
        now, done, id_type = None, [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in frames:
            id_type = batch.column(0).type
            for conv_id, formatted, start, end, attachments in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv_id)
                now.add(formatted, start, end, attachments)
            if len(done) >= 2000:
                yield flush()
                done.clear()
        if now is not None:
            done.append(now.row())
            yield flush()

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"
    return format_rows(conversations).select("conv_id", "formatted", "loss_start", "loss_end", "attachments").mapInArrow(run, schema)


PROBE_ID = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus a conversation whose texts hold the template's own control strings."""
    spark = conversations.sparkSession
    kinds = {c: conversations.schema[c].dataType for c in ("conv_id", "turn")}
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    if _has_parts(conversations):
        return with_parts(conversations).unionByName(with_parts(probe))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
