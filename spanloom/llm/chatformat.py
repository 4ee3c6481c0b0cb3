"""Chat formatting that is checked by reading it back.

    conversation := turn*
    turn         := "<|" role "|>\\n" body "<|end|>\\n"
    role         := letters, digits, "_", "." and "-"; other bytes as %XX;
                    "~" for a null role; "!" behind it for a null text
    body         := text in which every "<|" is escaped

A body is first written as it is.  The rendered text is parsed again by a
deterministic parser and the turns found are compared with the source; the
turns that don't come back are escaped, until all do.  The escape puts a
backslash between "<" and "|", and one more where there are some, so it can
always be undone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = re.compile(r"<\|((?:[A-Za-z0-9_.-]|%[0-9A-F]{2})*|~)(!?)\|>\n")
_END = "<|end|>\n"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

Turn = tuple[str | None, str | None]


class FormatError(ValueError):
    """The text isn't a rendered conversation."""


def render(turns: list[Turn], escaped: set[int] = frozenset()) -> str:
    """The turns as text; those numbered in ``escaped`` with their body escaped."""
    out = []
    for k, (role, text) in enumerate(turns):
        name = "~" if role is None else quote(role, safe="").replace("~", "%7E")
        body = "" if text is None else _MARK.sub(r"<\\\1|", text) if k in escaped else text
        out.append(f"<|{name}{'!' if text is None else ''}|>\n{body}{_END}")
    return "".join(out)


def parse(text: str) -> list[Turn]:
    """The turns of a rendered conversation; raises FormatError on any other text."""
    at, turns = 0, []
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise FormatError(f"no turn begins at {at}")
        stop = text.find("<|", head.end())
        if stop < 0 or not text.startswith(_END, stop):
            raise FormatError(f"the turn at {at} doesn't end")
        body = text[head.end() : stop]
        if head[2] and body:
            raise FormatError(f"the turn at {at} has a text and none")
        turns.append((None if head[1] == "~" else unquote(head[1]), None if head[2] else _ESCAPED.sub(r"<\1|", body)))
        at = stop + len(_END)
    return turns


def _survives(turns: list[Turn], escaped: set[int]) -> bool:
    try:
        return parse(render(turns, escaped)) == turns
    except FormatError:
        return False


def round_trip(turns: list[Turn]) -> tuple[str, int]:
    """(rendered text, turns escaped) such that parsing the text gives the turns."""
    escaped: set[int] = set()
    while not _survives(turns, escaped):
        more = {k for k, t in enumerate(turns) if k not in escaped and not _survives([t], set())}
        if not more:
            raise FormatError("the turns can't be told apart")
        escaped |= more
    return render(turns, escaped), len(escaped)


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_escaped, rendered) of each conversation, its turns in order.

    Turns of equal number (repeated rows too) go by role, then text, nulls
    first, and all stay.  A null role or text is written so that it comes back
    as null; an empty text stays empty.  A row of a null id belongs to
    no other and is a conversation of its own.  Other columns aren't read.  An empty table
    gives an empty result.
    """
    kind = turns.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(len(c), *round_trip([(t["role"], t["text"]) for t in c])) for c in batch.column(1).to_pylist()]
            n, text, escaped = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(escaped, pa.int64()), pa.array(text, pa.string())], [id_col, "n_turns", "n_escaped", "rendered"])

    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    laid = turns.select(F.col(id_col), one.alias("_t"))
    whole = laid.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    whole = whole.unionByName(laid.filter(F.col(id_col).isNull()).withColumn("_t", F.array("_t")))
    return whole.mapInArrow(run, f"`{id_col}` {kind}, n_turns long, n_escaped long, rendered string")
