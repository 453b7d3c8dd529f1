"""Chat formatting that is checked by reading it back.

Grammar of the formatted text::

    conversation := turn*
    turn         := "### " role ": " body "</turn>\\n"

A backslash makes the next character plain.  A body ends at the first plain
``</turn>``; a plain ``###`` inside a body or role, or a plain ``: `` inside a role, is an
error.  Each turn is rendered as it is and read back by the parser; where the reading
differs from the source, the turn's conflicting content is escaped, and so on by
rising levels until the reading is identical.  A turn's reading does not depend on
its neighbours, as a parser stands between two turns after each ``</turn>\\n``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
FORMATTED = "conv_id long, turn_index long, formatted string, mask_start long, mask_length long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: What each level escapes: nothing; control strings and backslashes; all but letters and digits.
_LEVELS = (None, re.compile(r"\\|#(?=##)|(?<=##)#|(?<=#)#(?=#)|<(?=/turn>)|:(?= )"), re.compile(r"[^\w]|_"))
_STOP = re.compile(r"\\(.)|(###)|(</turn>)|(: )|(\\)\Z", re.S)


class Conflict(ValueError):
    """The text is not of the grammar."""


def _scan(text: str, at: int, ends: str) -> tuple[str, int]:
    """Plain text from ``at`` to the plain ``ends``, and the place after it."""
    out, last = [], at
    for m in _STOP.finditer(text, at):
        if m[1] is not None:
            out += [text[last : m.start()], m[1]]
            last = m.end()
        elif m[0] == ends:
            return "".join([*out, text[last : m.start()]]), m.end()
        elif m[0] == "###" or m[0] == "\\" or m[0] == "</turn>":
            raise Conflict(f"plain {m[0]!r} at {m.start()}")
    raise Conflict(f"no {ends!r} after {at}")


def parse(text: str) -> list[tuple[str, str]]:
    """(role, body) of each turn of formatted text."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise Conflict(f"no turn at {at}")
        role, at = _scan(text, at + len(OPEN), COLON)
        body, at = _scan(text, at, "</turn>")
        if text[at : at + 1] != "\n":
            raise Conflict(f"no line end at {at}")
        turns.append((role, body))
        at += 1
    return turns


def unescape(body: str) -> str:
    return re.sub(r"\\(.)", r"\1", body, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and length of its body), after the first level whose reading is identical."""
    for rule in _LEVELS:
        head, body = (role, text) if rule is None else (rule.sub(r"\\\g<0>", role), rule.sub(r"\\\g<0>", text))
        formatted = f"{OPEN}{head}{COLON}{body}{CLOSE}"
        try:
            if parse(formatted) == [(role, text)]:
                return formatted, len(OPEN) + len(head) + len(COLON), len(body)
        except Conflict:
            continue
    raise Conflict(f"no level makes the turn of {role!r} readable")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as Arrow, in which integers beside nulls keep all their bits."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _sorted(turns: DataFrame) -> DataFrame:
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per turn, in order within each conversation; their ``formatted`` texts, joined, are the conversation.

    ``mask_start`` and ``mask_length`` (code points of the conversation's text) mark the
    body of a turn under the loss, else length 0 and a null start.  Null roles and texts
    are empty; turns that tie are ordered by role and text; repeated rows are repeated
    turns; a null conv_id is a conversation; an empty table gives an empty result.
    Turns stream through a task in order, so a conversation of any length takes little memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, length, begun = None, 0, 0, False
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not begun or conv != now:
                    now, index, length, begun = conv, 0, 0, True
                formatted, start, n = render(role, text)
                masked = role == loss_role
                out.append((conv, index, formatted, length + start if masked else None, n if masked else 0))
                index, length = index + 1, length + len(formatted)
            yield _batch(out, FORMATTED)

    return _sorted(turns).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser and the loss mask recover from the rows of ``format_turns``, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            return (now, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"])

        for b in batches:
            out = []
            for conv, text, start, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask_start", "mask_length")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
                for role, body in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{body}\n".encode())
                if n:
                    at = start - state["length"]
                    under = unescape(text[at : at + n])
                    state["chars"] += len(under)
                    state["loss"].update(under.encode())
                state["length"] += len(text)
            yield _batch(out, DIGEST)
        if state is not None:
            yield _batch([row()], DIGEST)

    return formatted.mapInArrow(run, DIGEST)
