"""Clean-up of detected spans, all of it on arrays within the document's row."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.functions.arrays import rows_of
from spanloom.functions.offsets import BYTES, CHARS, _col, cut, size

#: Separators that end a person's name; a space doesn't, as names hold spaces.
PERSON_SEPARATORS = "(),/|、・，（）／｜"
_RUNS = f"[^{PERSON_SEPARATORS}]+|[{PERSON_SEPARATORS}]+"
#: What is trimmed at the edges; the equals sign goes only in front, as keys may end with it.
EDGE, WIDE_EDGE = r"\x{0}-\x{20}\x{3000}", r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ASCII_EDGE = r"\x{0}-\x{20}"
MERGE_GAP = 4


def drop_outside(text, spans, unit: str = BYTES) -> Column:
    """Spans that lie in the text and aren't empty."""
    whole = size(text, unit)
    return F.filter(_col(spans), lambda s: (s["start"] >= 0) & (s["end"] <= whole) & (s["start"] < s["end"]))


def from_tokens(spans, tokens, text, unit: str = BYTES) -> Column:
    """Token spans (label, tok_begin, tok_end, score) with the offsets of their tokens; bad ones are dropped."""
    tokens = _col(tokens)
    at = F.transform(
        _col(spans),
        lambda s: F.struct(F.element_at(tokens, s["tok_begin"] + 1)["start"].alias("start"), F.element_at(tokens, s["tok_end"] + 1)["end"].alias("end"), s["score"].alias("score"), s["label"].alias("label")),
    )
    return drop_outside(text, at, unit)


def split_persons(text, spans, unit: str = BYTES, label: str = "private_person") -> Column:
    """Each name of an enumeration of persons as a span of its own, with the score of the whole."""

    def parts(s):
        found = F.regexp_extract_all(cut(text, s["start"], s["end"], unit), F.lit(_RUNS), F.lit(0))

        def step(acc, p):
            end = acc["at"] + size(p, unit)
            part = F.array_append(acc["out"], s.withField("start", acc["at"]).withField("end", end))
            return F.struct(end.alias("at"), F.when(p.rlike(f"^[^{PERSON_SEPARATORS}]"), part).otherwise(acc["out"]).alias("out"))

        return F.aggregate(found, F.struct(s["start"].alias("at"), F.filter(F.array(s), lambda _: F.lit(False)).alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(_col(spans), lambda s: F.when(s["label"] == label, parts(s)).otherwise(F.array(s))))


def trim(text, spans, unit: str = BYTES, edge: str = EDGE, equals: bool = True) -> Column:
    """Spans without white space at the edges, nor equals signs in front; what is empty then is dropped."""

    def one(s):
        x = cut(text, s["start"], s["end"], unit)
        lead = size(F.regexp_extract(x, f"^[{edge}{'=' if equals else ''}]*", 0), unit)
        tail = size(F.regexp_extract(x, f"[{edge}]*$", 0), unit)
        return s.withField("start", s["start"] + lead).withField("end", F.greatest(s["end"] - tail, s["start"] + lead))

    return F.filter(F.transform(_col(spans), one), lambda s: s["start"] < s["end"])


def remap_labels(spans) -> Column:
    """Spans with target labels; those of labels that have none are dropped."""
    return F.filter(F.transform(_col(spans), lambda s: s.withField("label", L.remap(s["label"]))), lambda s: s["label"].isNotNull())


def merged(text: str | bytes | None, spans: list[tuple[int, int, str | None]], gap: int = MERGE_GAP) -> list[tuple[int, int, int]]:
    """(start, end, which) of merged spans (start, end, label), by start, offsets into ``text``; ``which`` is the last span that joined.

    One that follows the last merged span of its label over at most ``gap`` of
    white space joins it.
    """
    out: list[tuple[int, int, int]] = []
    start, end, label, which = 0, 0, None, -1
    for i in sorted(range(len(spans)), key=lambda i: spans[i][0]):
        s, e, name = spans[i]
        if which >= 0 and name is not None and name == label and s - end <= gap and (s <= end or text is not None and _blank(text[max(end, 0) : max(s, 0)])):
            end, which = max(end, e), i
            continue
        if which >= 0:
            out.append((start, end, which))
        start, end, label, which = s, e, name, i
    return [*out, (start, end, which)] if which >= 0 else out


_BLANK = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WIDE_EDGE) + "]*")


def _blank(between: str | bytes) -> bool:
    return _BLANK.fullmatch(between if isinstance(between, str) else between.decode("utf-8", "replace")) is not None


def merge_near(text, spans, gap: int = MERGE_GAP, unit: str = CHARS) -> Column:
    """Spans by start; one that follows the last merged span of its label over at most ``gap`` of white space joins it."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("which", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,end:int,which:int>>")
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for raw, own in zip(texts, found):
            if not own.is_valid:
                out.append(None)
                continue
            raw = raw.as_py()
            at = raw if unit == BYTES or raw is None else raw.decode("utf-8", "replace")
            out.append([{"start": s, "end": e, "which": i} for s, e, i in merged(at, [(x["start"], x["end"], x["label"]) for x in own.as_py()], gap)])
        return pa.array(out, kind)

    plain = F.transform(_col(spans), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label")))
    once = F.array(F.struct(_col(spans).alias("spans"), run(_col(text).cast("binary"), plain).alias("merged")))  # worked out once, not once a span
    return F.transform(once, lambda x: F.transform(x["merged"], lambda m: F.element_at(x["spans"], m["which"] + 1).withField("start", m["start"]).withField("end", m["end"])))[0]


def merged_rows(docs: DataFrame, keys: tuple[str, ...], pattern: str, label: str, text_col: str = "text", gap: int = MERGE_GAP) -> DataFrame:
    """(keys, start, end, label): a row for each merged span of a pattern's matches in a text, offsets in characters.

    The pattern must be such as Java and Python read alike.
    """
    found = re.compile(pattern)

    def make(texts):
        out = [merged(t, [(*m.span(), label) for m in found.finditer(t)], gap) for t in ((raw or b"").decode("utf-8", "replace") for raw in texts)]
        flat = np.array([x[:2] for own in out for x in own], np.int64).reshape(-1, 2)
        return np.array([len(x) for x in out]), [np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1]), pa.array([label] * len(flat), pa.string())]

    return rows_of(docs, keys, [_col(text_col).cast("binary")], "start bigint, end bigint, label string", make)


def clean(text, spans, unit: str = BYTES) -> Column:
    """The runtime's clean-up: spans in range, persons apart, edges trimmed."""
    return trim(text, split_persons(text, drop_outside(text, spans, unit), unit), unit)


def clean_bytes(texts: list[bytes], row: np.ndarray, start: np.ndarray, end: np.ndarray, person: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``clean`` makes of spans in bytes, ordered by their text (``row``): of each span that stays which it was, its start and its end.

    ``person`` marks spans of persons.  The work grows with the texts' bytes
    and the spans, not with their product.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    which = np.flatnonzero((start >= 0) & (end <= sizes[row]) & (start < end))
    start, end = start[which].astype(np.int64) + base[row[which]], end[which].astype(np.int64) + base[row[which]]
    blob = b"".join(texts)
    if (among := np.flatnonzero(person[which])).size:
        parts, before = [], 0
        for k in among.tolist():
            parts.append((np.arange(before, k), start[before:k], end[before:k]))
            at, before = int(start[k]), k + 1
            for m in re.finditer(_RUNS, blob[at : int(end[k])].decode("utf-8", "surrogateescape")):
                stop = at + len(m[0].encode("utf-8", "surrogateescape"))
                if m[0][0] not in PERSON_SEPARATORS:
                    parts.append((np.array([k]), np.array([at]), np.array([stop])))
                at = stop
        parts.append((np.arange(before, len(which)), start[before:], end[before:]))
        kept, start, end = (np.concatenate([x[i] for x in parts]) for i in range(3))
        which = which[kept]
    raw = np.frombuffer(blob, np.uint8)
    edge = raw <= 0x20
    wide = np.flatnonzero((raw[:-2] == 0xE3) & (raw[1:-1] == 0x80) & (raw[2:] == 0x80))
    for k in range(3):
        edge[wide + k] = True  # U+3000
    n, places = len(raw), np.arange(len(raw))
    inner = np.append(np.minimum.accumulate(np.where(edge | (raw == ord("=")), n, places)[::-1])[::-1], n)
    outer = np.concatenate([[0], np.maximum.accumulate(np.where(edge, 0, places + 1))])
    start = np.minimum(inner[start], end)
    end = np.maximum(outer[end], start)
    stays = start < end
    which, start, end = which[stays], start[stays], end[stays]
    return which, start - base[row[which]], end - base[row[which]]


def clean_lenient(text, spans) -> Column:
    """The evaluation route's clean-up, in code points: remap, merge, persons apart, wider trim."""
    return trim(text, split_persons(text, merge_near(text, remap_labels(spans)), CHARS), CHARS, WIDE_EDGE)


def clean_plain(text, spans, unit: str = BYTES) -> Column:
    """The low-level mode: ASCII trim only."""
    return trim(text, drop_outside(text, spans, unit), unit, ASCII_EDGE, equals=False)
