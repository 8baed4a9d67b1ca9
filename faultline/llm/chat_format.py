"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens the parts into text and ordered placeholders,
records a reference for each attachment, and counts the tokens that a placeholder will expand to. Each turn is written as

    <|im_start|>role\\n body <|im_end|>\\n

with control strings inside role and body escaped reversibly: a backslash goes between `<` and a following `|`, `\\` or `~`, also
where these stand in two text parts, and a line feed in a role becomes `<~`. The loss mask covers the text parts of assistant turns,
with adjoining parts as one span. Output rows are one per turn, so a long
conversation is spread over tasks; only digests, which are sequential, stream a conversation through one task in order.

Defined results: a null text is an empty text part, a null role an empty role; a null conversation id is a conversation of its
own; rows of equal turn numbers are ordered by their formatted text, null turns first. Unknown part types become documents
without pages. Repeated rows are repeated turns. Empty tables give empty ones; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: Pixels along a side of an image patch, tokens of a second of sound and of a document's page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 600
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "struct<kind: string, ref: string, number: int, at: long, tokens: long>"
TURN = (
    f"conv_id long, turn long, formatted string, loss array<struct<start: long, end: long>>, attachments array<{ATTACHMENT}>, "
    "text_words long, tokens long"
)
#: The control strings of conversation -1.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"
_TAKE = re.compile(r"<(?=[|\\~])")
_AFTER = ("|", "\\", "~")
_GIVE = re.compile(r"<([\\~])")
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document) [0-9]+\|>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _TAKE.sub("<\\\\", text)


def unescape(text: str) -> str:
    return _GIVE.sub(lambda m: "<" if m[1] == "\\" else "\n", text)


class Flattener:
    """Visits the parts of one message, in order."""

    def __init__(self, at: int):
        self.out: list[str] = []
        self.at = at  # code points before the next piece
        self.attachments: list[dict] = []
        self.texts: list[dict] = []
        self.words = 0
        self.tokens = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_document)(part)

    def put(self, piece: str) -> None:
        self.out.append(piece)
        self.at += len(piece)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        start = self.at
        if self.out and self.out[-1].endswith("<") and text[:1] in _AFTER:
            self.put("\\")  # the control string would come together from two parts
        if text:
            self.put(escape(text))
        if self.at > start and self.texts and self.texts[-1]["end"] == start:
            self.texts[-1]["end"] = self.at
        elif self.at > start:
            self.texts.append({"start": start, "end": self.at})
        self.words += len(text.split())

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, ceil((part.get("width") or 0) / PATCH) * ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, ceil((part.get("seconds") or 0) * PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PER_PAGE)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "number": number, "at": self.at, "tokens": max(tokens, 0)})
        self.tokens += max(tokens, 0)
        self.put(f"<|{kind} {number}|>")


def format_turn(role: str, parts: list[dict]) -> dict:
    """One turn; places are code points of its formatted text."""
    head = f"{START}{escape(role).replace(chr(10), '<~')}\n"
    visitor = Flattener(len(head))
    for part in parts:
        visitor.visit(part or {})
    return {
        "formatted": f"{head}{''.join(visitor.out)}{END}\n",
        "loss": visitor.texts if role == LEARNED else [],
        "attachments": visitor.attachments,
        "text_words": visitor.words,
        "tokens": visitor.tokens,
    }


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders are no text."""
    return [
        (unescape(m[1]), "".join(map(unescape, _PLACEHOLDER.split(m[2])))) for m in _TURN.finditer(formatted)
    ]


def text_part(column: str) -> Column:
    """A list of one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    text = F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")
    return F.array(F.struct(F.lit("text").alias("type"), text, *[F.lit(None).cast(k).alias(c) for c, k in none.items()]))


def text_parts(conversations: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as messages of one text part."""
    return conversations.select("conv_id", "turn", "role", text_part("text").alias("parts"))


def json_parts(conversations: DataFrame, column: str = "content") -> DataFrame:
    """Conversations whose content is a JSON list of parts; what is no such list is taken as text."""
    read = F.from_json(F.col(column), f"array<{PART}>")
    typed = F.coalesce(F.size(F.filter(read, lambda p: p["type"].isNotNull())) > 0, F.lit(False))
    is_list = F.coalesce(F.ltrim(column).startswith("["), F.lit(False)) & typed
    return conversations.select("conv_id", "turn", "role", F.when(is_list, read).otherwise(text_part(column)).alias("parts"))


_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("attachments", pa.list_(pa.struct(
            [("kind", pa.string()), ("ref", pa.string()), ("number", pa.int32()), ("at", pa.int64()), ("tokens", pa.int64())]
        ))),
        ("text_words", pa.int64()), ("tokens", pa.int64()),
    ]
)


def format_chats(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, parts) to one row per turn, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"conv_id": r["conv_id"], "turn": r["turn"], **format_turn(r["role"] or "", r["parts"] or [])} for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "parts")
    return common.store(rows.mapInArrow(run, TURN), "chats")


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted turns: roles and texts, and the text under the loss mask, unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = None, None

        def close() -> tuple:
            return now[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]

        def table(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))
            for conv, formatted, loss in zip(*columns, strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(close())
                    now = (conv,)
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                for role, text in parse_turns(formatted):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["all"] += len(formatted)
            yield table(done)
        if now is not None:
            yield table([close()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = turns.select("conv_id", "turn", "formatted", "loss").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, schema)


def op3_typed_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = common.read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(LEARNED)).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return read_back(format_chats(text_parts(rows.union(control))))
