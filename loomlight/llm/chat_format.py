"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

``TEMPLATE`` states for each role what stands before and after its text and whether the
text carries loss; ``ORDER`` states which role may follow which. ``format_turns`` walks a
conversation's rows in order, one turn at a time, and emits text segments with a loss
flag. Control strings inside texts (and the escape character) are escaped, so that
``read_back`` finds the turns again from the segments alone.

Memory does not grow with a conversation: rows are dealt by conversation, sorted, and
streamed through the machine; digests are taken as the segments pass.

Order: by turn (null first), then role, then text, so ties and repeated rows have one
order. A null text or role is empty, rows with a null conversation id are one
conversation. Turns that break ORDER are formatted all the same and flagged invalid.
Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_cache

#: role: (before, after, whether the text carries loss)
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Any other role: its escaped name stands between the first and the second.
OTHER = ("<|role|>", "<|text|>", "<|end|>")
#: state: the roles that may come next. The state after a turn is its role.
ORDER = {
    "start": {"system", "user"},
    "system": {"user"},
    "user": {"assistant"},
    "assistant": {"user"},
}
#: States in which a conversation may end.
FINAL = {"assistant"}

ESCAPE = "\\"
CONTROLS = sorted({x.strip() for before, after, _ in TEMPLATE.values() for x in (before, after)} | set(OTHER), key=lambda x: (-len(x), x))
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TO_ESCAPE = re.compile("|".join(map(re.escape, [ESCAPE, *CONTROLS])))
_ESCAPED = re.compile(r"\\([\\;])")

Segment = tuple[str, bool]


def escape(text: str) -> str:
    """No control string is left; unescape() gives the text back."""
    return _TO_ESCAPE.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else f"{m[0][0]}{ESCAPE};{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == ESCAPE else "", text)


def next_state(state: str, role: str) -> tuple[str, bool]:
    """The state after a turn of this role and whether the turn may stand there."""
    allowed = role in ORDER.get(state, ())
    return (role if role in ORDER else state), allowed


def segments(role: str, text: str) -> list[Segment]:
    """What the template makes of a turn."""
    if role in TEMPLATE:
        before, after, loss = TEMPLATE[role]
        return [(before, False), (escape(text), loss), (after, False)]
    start, middle, end = OTHER
    return [(start, False), (escape(role), False), (middle, False), (escape(text), False), (end, False)]


_OPENS = {before.strip(): role for role, (before, _, _) in TEMPLATE.items()} | {OTHER[0]: None}


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of the one turn that this output holds."""
    marks = list(_CONTROL.finditer(formatted))
    role = _OPENS[marks[0][0]]
    if role is None:
        return unescape(formatted[marks[0].end() : marks[1].start()]), unescape(formatted[marks[1].end() : marks[2].start()])
    before, after, _ = TEMPLATE[role]
    return role, unescape(formatted[len(before) : len(formatted) - len(after)])


def _ordered(turns: DataFrame) -> DataFrame:
    found = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, segments (array of text and loss), valid: a row for each turn, in order within each partition.

    valid: the machine allows the role after what came before.
    """
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("chat_format")
        now, state = object(), "start"
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            made, valid = [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, state = conv, "start"
                state, allowed = next_state(state, role)
                made.append([{"text": x, "loss": loss} for x, loss in segments(role, text)])
                valid.append(allowed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, kind), pa.array(valid, pa.bool_())], ["conv_id", "turn", "segments", "valid"])

    return _ordered(turns).mapInArrow(run, "conv_id long, turn long, segments array<struct<text:string,loss:boolean>>, valid boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the segments of format_turns() hold, a row for each conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid (every
    turn was allowed and the conversation ended in a final state).
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    class Totals:
        def __init__(self, conv: int | None) -> None:
            self.conv, self.turns, self.loss_chars, self.chars, self.valid, self.role = conv, 0, 0, 0, True, "start"
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, made: list[dict], allowed: bool) -> None:
            output = "".join(x["text"] for x in made)
            self.role, text = parse_turn(output)
            self.turns += 1
            self.chars += len(output)
            self.valid &= allowed
            self.all.update(f"{self.role}\n{text}\n".encode())
            for x in made:
                if x["loss"]:
                    part = unescape(x["text"])
                    self.loss_chars += len(part)
                    self.loss.update(part.encode())

        def row(self) -> list:
            return [self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid and self.role in FINAL]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("chat_format")
        now: Totals | None = None
        for batch in batches:
            done = []
            for conv, made, allowed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now is None or conv != now.conv:
                    done += [now.row()] if now else []
                    now = Totals(conv)
                now.add(made, allowed)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), types, strict=True)], names)

    return formatted.mapInArrow(run, schema)
