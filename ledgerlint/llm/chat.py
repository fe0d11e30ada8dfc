"""Chat formatting: incremental black-box rendering with a loss mask over the assistant's texts.

A template is any function from a list of ``(role, text)`` turns to a string. It is never taken apart: the prefix
up to a turn and the prefix before it are rendered, and what the longer output adds is the turn's span. Inside the
span the text is found by rendering the turn with two probe texts: what the two outputs share in front and at the
end is the frame. A template whose longer output does not start with the shorter one rewrites history; its turns
are reported as such and get no span of their own.

Prefixes are whole, from the first turn of the conversation on, at every turn and for every template: what a template does
with the number of turns or with any earlier turn shows in the pieces or as rewritten history. That holds a conversation in
memory and costs the square of its length. How a template was built changes nothing in that: one that ``per_turn`` joins
from a function of one turn is rendered on whole prefixes as well.

A template of whole conversations can be declared to render each turn by itself with ``turn_local``. The declaration saves
nothing; it is verified: from the turn on whose whole prefix gives another piece than its last ``WINDOW`` turns, the turns
of the conversation are reported as rewritten history.

``plain_template`` marks turns with four control strings and escapes them in roles and texts by one backslash after
their first character (and one more where there are some already), which can be undone exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns that the piece of a template declared turn-local may depend on, its own included.
WINDOW = 8
PROBES = ("A", "B")
CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]")
_ESCAPE = re.compile(r"([<\[])(\\*)(?=s>|/s>|INST\]|/INST\])")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(?=s>|/s>|INST\]|/INST\])")


def escape(text: str) -> str:
    """``text`` without control strings; ``unescape`` undoes it exactly."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def turn_local(template: Template) -> Template:
    """Declares that ``template`` renders each turn without regard to the other turns and their number."""
    template.turn_local = True
    return template


def per_turn(render: Callable[[str, str], str]) -> Template:
    """The template that joins ``render(role, text)`` of all turns."""

    def template(turns: list[Turn]) -> str:
        return "".join(render(role, text) for role, text in turns)

    return template


def _plain_turn(role: str, text: str) -> str:
    return f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>\n"


plain_template = per_turn(_plain_turn)


_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>\n", re.S)


def read_turns(formatted: str) -> list[Turn]:
    """The turns that ``plain_template`` rendered; anything else is an error."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            raise ValueError(f"not a turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at character {at}")
    return turns


def locate(template: Template, before: list[Turn], turn: Turn,
           shorter: str | None = None) -> tuple[str, int, int, bool, str]:
    """What ``turn`` adds after ``before``: the rendered piece, where its text starts and ends, history rewritten;
    and the whole output. ``shorter`` is the output for ``before``, where it is known; the empty text before the first
    turn, whose piece so begins with whatever the template puts in front of a conversation.

    With rewritten history the piece is empty and so is its text.
    """
    if shorter is None:
        shorter = template(list(before))
    longer = template([*before, turn])
    probes = [template([*before, (turn[0], probe)]) for probe in PROBES]
    if not all(out.startswith(shorter) for out in (longer, *probes)):
        return "", 0, 0, True, longer
    piece, (one, other) = longer[len(shorter):], (out[len(shorter):] for out in probes)
    front = len(os.path.commonprefix([one, other]))
    end = len(os.path.commonprefix([one[::-1], other[::-1]]))
    return piece, front, len(piece) - end, False, longer


ROWS = ("position long, role string, piece string, text_start long, text_end long, in_loss boolean, "
        "rewrites_history boolean")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def format_turns(turns: DataFrame, template: Template = plain_template, key: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """One row per turn: key, ``position`` from 0, role, the rendered ``piece``, where its text lies in the piece,
    ``in_loss`` (the text of a ``learned`` turn) and ``rewrites_history``. The pieces of a conversation, in order,
    are its formatted text. Rows of a conversation lie together and in order in one partition.

    Rows are ordered by turn (NULL first), then role, then text, so equal turn numbers have a defined order; repeated
    rows are turns of their own. NULL role and text count as empty, NULL keys form one conversation. Other columns
    are not read. Partitions are streamed: a task holds the turns of one conversation so far.
    """
    declared = getattr(template, "turn_local", False)
    source = turns.select(F.col(key).alias(key), F.col(turn).alias("__turn"),
                          F.coalesce(role, F.lit("")).alias("__role"), F.coalesce(text, F.lit("")).alias("__text"))
    ordered = source.repartition(key).sortWithinPartitions(key, "__turn", "__role", "__text")
    ordered = ordered.select(key, "__role", "__text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, before, shorter, false = (), 0, [], "", False
        for batch in batches:
            rows = []
            for k, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k,) != current:
                    current, position, before, shorter, false = (k,), 0, [], "", False
                piece, start, end, rewrites, longer = locate(template, before, (r, t), shorter)
                if declared and position >= WINDOW:
                    false = false or piece != locate(template, before[1 - WINDOW:], (r, t))[0]
                if false:
                    piece, start, end, rewrites = "", 0, 0, True
                rows.append((position, r, piece, start, end, r == learned and not rewrites, rewrites))
                before.append((r, t))
                shorter = longer
                position += 1
            names = [key, *(x.split()[0] for x in ROWS.split(", "))]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return ordered.mapInArrow(render, f"`{key}` {_type(turns, key)}, {ROWS}")


DIGESTS = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "rewrites_history boolean")


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation of ``format_turns``, with what its formatted text says when it is read again.

    Works in the partitions and order that ``format_turns`` left, without another shuffle. The digests are fed turn
    by turn, so a task holds one turn. Only for ``plain_template``, whose texts can be read back.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for k, position, piece, start, end, learned, rewrites in zip(
                *(batch.column(i).to_pylist() for i in range(7))
            ):
                if position == 0:
                    if state:
                        done.append(finished(state))
                    state = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for r, t in read_turns(piece):
                    state[1] += 1
                    state[2].update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                if learned:
                    masked = unescape(piece[start:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
                state[6] = state[6] or bool(rewrites)
            yield packed(done, batch.schema.field(0).type)
        if state:
            yield packed([finished(state)], batch.schema.field(0).type)

    def packed(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        names = [key, *(x.split()[0] for x in DIGESTS.split(", "))]
        kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def finished(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]

    rows = formatted.select(key, "position", "piece", "text_start", "text_end", "in_loss", "rewrites_history")
    return rows.mapInArrow(digest, f"`{key}` {_type(formatted, key)}, {DIGESTS}")
