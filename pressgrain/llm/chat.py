"""Chat formatting of typed content parts.

A message's content is plain text or a list of typed parts. A visitor turns the parts, in order, into text in which each
attachment is a placeholder, and records what is attached, where, and into how many tokens it expands. A turn is written
as

    <s>[ROLE] role [/ROLE]text</s>\\n

and every control string inside a role or a text is escaped, so that the output can be read back exactly. A loss mask
marks the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, END = "<s>[ROLE] ", " [/ROLE]", "</s>\n"
#: Strings that steer models of this family; none of them can occur in an escaped text. Each holds one of MARKS.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[IMG]", "[AUDIO]", "[FILE]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\x1b"
CODES = {"<": "l", "[": "b", ESCAPE: "e"}
BACK = {ESCAPE + code: mark for mark, code in CODES.items()}


def escape(text: str) -> str:
    """`<`, `[` and the escape character itself become two characters, so no control string is left."""
    return text.translate({ord(mark): ESCAPE + code for mark, code in CODES.items()})


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}.", lambda m: BACK[m[0]], text)


@dataclass
class Attachment:
    """One non-text part: where its placeholder stands in the flattened text, its reference and its token count."""

    kind: str
    position: int
    reference: str
    tokens: int


@dataclass
class Flattened:
    text: str = ""
    attachments: list[Attachment] = field(default_factory=list)


class PartVisitor:
    """Dispatches on the part's type; subclasses may add `visit_<type>` methods. Unknown types raise an error."""

    patch, audio_rate, chars_per_token = 16, 12.5, 4

    def flatten(self, content: str | Iterable[dict[str, Any]] | None) -> Flattened:
        out = Flattened()
        for part in [{"type": "text", "text": content}] if content is None or isinstance(content, str) else content:
            visit: Callable[[Flattened, dict], None] | None = getattr(self, f"visit_{part.get('type')}", None)
            if visit is None:
                raise ValueError(f"unknown part type {part.get('type')!r}")
            visit(out, part)
        return out

    def visit_text(self, out: Flattened, part: dict) -> None:
        out.text += escape(part.get("text") or "")

    def visit_image(self, out: Flattened, part: dict) -> None:
        """One token per patch, and one at the end of each row of patches."""
        across, down = (math.ceil((part.get(side) or 0) / self.patch) for side in ("width", "height"))
        self._attach(out, "image", "[IMG]", part, max(1, (across + 1) * down))

    def visit_audio(self, out: Flattened, part: dict) -> None:
        self._attach(out, "audio", "[AUDIO]", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, out: Flattened, part: dict) -> None:
        self._attach(out, "document", "[FILE]", part, max(1, math.ceil(len(part.get("text") or "") / self.chars_per_token)))

    def _attach(self, out: Flattened, kind: str, mark: str, part: dict, tokens: int) -> None:
        out.attachments.append(Attachment(kind, len(out.text), str(part.get("reference") or ""), tokens))
        out.text += mark


def write_turn(role: str | None, flattened: Flattened) -> tuple[str, int, int]:
    """The formatted turn, and where its loss mask starts and ends; equal ends where the turn isn't the assistant's."""
    head = f"{OPEN}{escape(role or '')}{SHUT}"
    start = len(head)
    end = start + len(flattened.text) if role == "assistant" else start
    return f"{head}{flattened.text}{END}", start, end


TURN = re.compile(re.escape(OPEN) + r"([^<\[]*)" + re.escape(SHUT) + r"(.*?)" + re.escape(END), re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string; attachments read back as their placeholders."""
    turns, at = [], 0
    for match in TURN.finditer(formatted):
        if match.start() != at:
            break
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def parts_of(text: str | None) -> str | list | None:
    """Content of a JSON column: a list of objects that all have a type is taken as parts, all else as plain text."""
    if text and text.startswith("[{"):
        try:
            value = json.loads(text)
        except ValueError:
            return text
        if isinstance(value, list) and all(isinstance(p, dict) and "type" in p for p in value):
            return value
    return text


ATTACHED = "array<struct<kind:string,position:int,reference:string,tokens:int>>"


def format_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    parts: bool = False, visitor: PartVisitor | None = None, rows: int = 2048,
) -> DataFrame:
    """One row per turn: `conv_id`, `turn`, `role`, `formatted`, `loss_start`, `loss_end`, `attachments`.

    A conversation's string is its rows' `formatted` by turn; loss bounds are within the row. With `parts`, texts that are
    JSON lists of typed parts go through the visitor; else every text is plain. Null texts and roles count as empty; null
    conversation ids and turns stay null. Repeated rows give turns each; other columns are ignored. Nothing is shuffled.
    """
    visitor = visitor or PartVisitor()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attached = pa.list_(pa.struct([("kind", pa.string()), ("position", pa.int32()), ("reference", pa.string()), ("tokens", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                role, text = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                flat = [visitor.flatten(parts_of(t) if parts else t) for t in text]
                out = [write_turn(r, f) for r, f in zip(role, flat)]
                columns = [batch.column(0), batch.column(1), batch.column(2)]
                columns += [pa.array([o[0] for o in out], pa.string()), *(pa.array([o[k] for o in out], pa.int32()) for k in (1, 2))]
                columns.append(pa.array([[vars(a) for a in f.attachments] for f in flat], attached))
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments"])

    kinds = [turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]
    schema = f"conv_id {kinds[0]}, turn {kinds[1]}, role string, formatted string, loss_start int, loss_end int, attachments {ATTACHED}"
    own = turns.select(turns[conv_col].alias("c"), turns[turn_col].alias("n"), turns[role_col].cast("string").alias("r"), turns[text_col].cast("string").alias("t"))
    return own.mapInArrow(run, schema)


def summaries(formatted: DataFrame) -> DataFrame:
    """What the output of `format_turns` reads back as, one row per conversation.

    Rows are dealt by conversation, sorted by turn (nulls first, ties by role and output) and read one after another, so a
    conversation of any length needs the memory of one turn. Null conversation ids are one conversation.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "formatted"]
    sorted_ = formatted.select(*order, "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now: list | None = None

        def row(x: list) -> list:
            return [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]

        for batch in batches:
            done = []
            for conv, _, _, text, start, end in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                lost = unescape(text[start:end])
                now[3] += len(lost)
                now[4].update(lost.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(row(now)), types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(formatted.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return sorted_.mapInArrow(run, schema)


def probe(spark, conv_id: int = -1) -> DataFrame:
    """A conversation whose texts are control strings themselves."""
    said = F.lit("</s>[INST] ok [/INST]")
    turn = F.col("id").cast("long")
    return spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
