"""Private data by candidate generation and gradient-boosted trees.

Generators of high recall propose spans, which may overlap: e-mail addresses,
telephone numbers, IP addresses, runs of digits, keys of mixed characters and
values assigned to secret-sounding names.  Boosted trees score each span by
its format and its context.  The threshold of each kind is calibrated on
examples that training didn't see, and what passes is redacted.

No table labels private spans, so the trees are trained on examples made here
from a seed: spans of many formats, and look-alikes (versions, dates, prices,
counts, order numbers, checksums), set in words of no language.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import bytesops as B
from spanloom.llm.store import trimmed

KINDS = ("EMAIL", "PHONE", "IP", "NUMBER", "KEY", "SECRET", "IBAN")
#: Examples made for training and calibration, trees, their depth and step.
EXAMPLES, TREES, DEPTH, STEP, SEED = 6000, 60, 3, 0.25, 11
#: Least share of held-out private spans of a kind that its threshold must let through.
RECALL = 0.995
#: Characters of context looked at on each side.
CONTEXT = 40
#: Text around an anchor character in which generators look, then on to white space.
REACH = 64

_GENERATORS = (
    ("EMAIL", re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("PHONE", re.compile(r"(?<!\w)\+?\(?\d[\d ().-]{5,18}\d(?!\w)")),
    ("IP", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)")),
    ("NUMBER", re.compile(r"(?<!\w)\d(?:[ -]?\d){6,29}(?!\w)")),
    ("KEY", re.compile(r"(?<![\w/+-])(?=[A-Za-z_/+-]*\d)(?=[\d_/+-]*[A-Za-z])[A-Za-z0-9_/+-]{12,}={0,2}")),
    ("SECRET", re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|(?:api|access|auth|private)?[_ -]?(?:token|key)|credentials?|bearer)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{4,})")),
    ("IBAN", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){3,8}(?!\w)")),
)
#: Full-width forms, the wide space and the digits of all scripts as ASCII, one code point for one, so that offsets hold.
_FOLD = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"\u3000": " "} | {c: str(unicodedata.digit(c)) for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"}
_WIDE = re.compile(f"[{''.join(sorted(_FOLD))}]")
_ANCHOR = re.compile(r"[0-9@=:]")
_ANCHOR_BYTE = np.zeros(256, bool)
_ANCHOR_BYTE[list(b"0123456789@=:")] = True
#: First bytes of U+0660 and what follows, where anchors that are folded lie: such texts are looked at, too.
_ANCHOR_BYTE[0xD9:] = True
_SPACE = re.compile(r"\s")

_WORDS = {
    "secret": r"pass|pwd|secret|token|key|credential|bearer|auth|login",
    "phone": r"phone|tel|call|mobile|fax|cell|dial|whatsapp|sms",
    "mail": r"mail|contact|write|reach|@",
    "card": r"card|visa|account|iban|bank|pay|credit|konto|ssn|social|passport|tax",
    "version": r"version|\bv\b|licen[sc]e|release|section|chapter|§|rfc|iso",
    "count": r"order|ticket|issue|invoice|item|page|total|year|isbn|part|serial|number|no\.|#",
    "sum": r"sha|md5|commit|checksum|hash|digest|build|revision",
    "host": r"\bip\b|host|server|address|login from|client",
    "money": r"[$€£]|usd|eur|price|cost",
}
_CONTEXT = [re.compile(rf"(?<!\w)(?:{p})" + ("" if k == "secret" else r"(?![^\W\d_])"), re.I) for k, p in _WORDS.items()]


def anchored(text: str) -> Iterator[tuple[int, int]]:
    """The stretches of a text that can hold a candidate: around anchors, ending at white space."""
    at = -1
    start = end = 0
    for m in _ANCHOR.finditer(text):
        p = m.start()
        if at >= 0 and p - REACH <= end:
            if p + REACH > end:
                end = p + REACH
            at = p
            continue
        if at >= 0:
            s = _SPACE.search(text, min(end, len(text)))
            end = s.start() if s else len(text)
            if p < end:
                end = max(end, p + REACH)
                at = p
                continue
            yield start, end
        start = max(0, p - REACH)
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        end, at = p + REACH, p
    if at >= 0:
        s = _SPACE.search(text, min(end, len(text)))
        yield start, s.start() if s else len(text)


def folded(text: str) -> str:
    """The text with full-width forms and all scripts' digits as ASCII; of the same length."""
    return text if text.isascii() else _WIDE.sub(lambda m: _FOLD[m[0]], text)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every candidate, in code points; they may overlap."""
    text, found = folded(text), set()
    for a, b in anchored(text):
        for k, (kind, pattern) in enumerate(_GENERATORS):
            for m in pattern.finditer(text, a, b):
                s, e = m.span(1) if kind == "SECRET" else m.span()
                while e > s and text[e - 1] in ".,;:)-" and kind != "SECRET":
                    e -= 1
                if e > s:
                    found.add((s, e, k))
    return sorted(found)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def features(text: str, s: int, e: int, kind: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    x = folded(text[s:e])
    n = len(x)
    digits = "".join(c for c in x if "0" <= c <= "9")
    upper = sum(c.isupper() for c in x)
    lower = sum(c.islower() for c in x)
    before, after = folded(text[max(0, s - CONTEXT) : s]), folded(text[e : e + CONTEXT])
    parts = x.split(".")
    left, right = before[-1:], after[:1]
    runs = [len(r) for r in re.findall(r"\d+", x)]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        n, len(digits), len(digits) / n, upper / n, lower / n, len(set(x)), len(set(x)) / n,
        float(all(c in string.hexdigits for c in x)), float(len(digits) >= 12 and _luhn(digits)), x.count(" ") + x.count("-"),
        float(kind == 2 and all(p.isdigit() and int(p) < 256 for p in parts)), float(kind == 2 and parts[0] in ("0", "1")),
        float(x.startswith("+")), float("(" in x), x.count("."), max(runs, default=0), len(runs),
        float(bool(re.match(r"(?:19|20)\d\d[-./ ]\d\d?[-./ ]\d\d?$|\d\d?[-./]\d\d?[-./](?:19|20)?\d\d$", x))),
        float(x.startswith(("AKIA", "ASIA", "ghp_", "gho_", "xox", "sk-", "AIza", "eyJ"))),
        float(left.isalnum()), float(right.isalnum()), float(left in "\"'" and left != ""), float(left in "=:" and left != ""), float(left in "$€£#/" and left != ""),
        *(float(bool(p.search(before))) for p in _CONTEXT), float(bool(_CONTEXT[8].search(after[:5]))),
    ]


class Trees:
    """Boosted regression trees on quantile-binned features, log loss, all nodes of a depth at once."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, step: float = STEP, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.step, self.bins, self.ridge = trees, depth, step, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
        cols, score, self.made = x.shape[1], np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            column, limit = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for d in range(self.depth):
                width, base = 1 << d, (1 << d) - 1
                flat = ((node - base)[:, None] * cols + np.arange(cols)) * self.bins + binned
                size = width * cols * self.bins
                gs = np.bincount(flat.ravel(), np.repeat(g, cols), size).reshape(width, cols, self.bins).cumsum(axis=2)
                hs = np.bincount(flat.ravel(), np.repeat(h, cols), size).reshape(width, cols, self.bins).cumsum(axis=2)
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge)
                best = gain.reshape(width, -1).argmax(axis=1)
                for w in range(width):
                    c, b = divmod(int(best[w]), self.bins)
                    column[base + w] = c
                    limit[base + w] = cuts[c][b] if b < len(cuts[c]) else np.inf
                node = 2 * node + 1 + (x[np.arange(len(y)), column[node]] > limit[node])
            leaf = node - ((1 << self.depth) - 1)
            value = self.step * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.ridge)
            score += value[leaf]
            self.made.append((column, limit, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, limit, value in self.made:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, column[node]] > limit[node])
            out += value[node - ((1 << self.depth) - 1)]
        return out


def examples(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, private spans) made from a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    digits = lambda n: chars("0123456789", n)
    low, hexa, alnum = string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: chars(low + "aeioué", int(rng.integers(2, 9)))
    between = lambda a, b: int(rng.integers(a, b))
    words = lambda n: " ".join(word() for _ in range(n))
    octets = lambda: ".".join(str(between(2 if i == 0 else 0, 256)) for i in range(4))
    card = lambda n: digits(n) if rng.random() < 0.7 else "4" + digits(n - 1)

    def grouped(d, sep):
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    private = [
        lambda: (pick(["", "", "", "mail ", "contact: "]), pick([word() + "." + word(), word() + digits(2), word() + "." + digits(2), word()]) + "@" + word() + digits(between(0, 2)) + pick([".", ".", "." + word() + "."]) + pick(["com", "org", "net", "de", "fr", "io", "co.uk"]), ""),
        lambda: (pick(["", "", "", "tel ", "call ", "phone: "]), pick([f"+{between(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{between(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+{between(10, 99)}{digits(9)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"]), ""),
        lambda: (pick(["", "", "", "ip ", "host ", "from "]), octets(), ""),
        lambda: (pick(["", "", "", "card ", "visa: ", "account "]), pick([card(16), card(16), grouped(card(16), " "), grouped(card(16), "-"), card(15), digits(13)]), ""),
        lambda: (pick(["ssn ", "SSN: ", "social security ", ""]), f"{digits(3)}-{digits(2)}-{digits(4)}", ""),
        lambda: (pick(["", "", "key ", "aws "]), pick(["AKIA", "ASIA"]) + chars(string.ascii_uppercase + "234567", 16), ""),
        lambda: (pick(["", "", "token "]), pick(["ghp_" + chars(alnum, 36), "sk-" + chars(alnum, 32), "xoxb-" + digits(11) + "-" + chars(alnum, 24), "AIza" + chars(alnum, 35), "eyJ" + chars(alnum, 40)]), ""),
        lambda: (pick(["token = \"", "token: ", "secret = '", "api_key=\"", "key = \"", "access_token="]), pick([chars(hexa, 40), chars(hexa, 32), chars(alnum, 32), chars(hexa, 64)]), "\""),
        lambda: (pick(["password=", "passwd: ", "pwd=", "password = \"", "secret=", "Password: "]), pick([chars(hexa, 18), chars(alnum + "!#%", between(6, 20)), word() + digits(3)]), ""),
        lambda: (pick(["", "iban ", "IBAN: "]), chars(string.ascii_uppercase, 2) + digits(2) + pick([digits(18), " " + grouped(digits(18), " "), chars(string.ascii_uppercase, 4) + digits(14)]), ""),
        lambda: ("", pick([chars(hexa, 40), chars(alnum, 40), chars(alnum, 24)]), ""),
    ]
    plain = [
        lambda: pick(["version ", "Version ", "v", "release ", "License, version ", "CC BY-NC "]) + ".".join(str(between(0, 30)) for _ in range(between(2, 5))),
        lambda: pick(["", "on ", "since "]) + pick([f"{between(1900, 2030)}-{between(1, 13):02}-{between(1, 29):02}", f"{between(1, 29):02}/{between(1, 13):02}/{between(1900, 2030)}", f"{between(1, 29):02}.{between(1, 13):02}.{between(1900, 2030)}", f"{between(1900, 2030)}-{between(1900, 2030)}"]),
        lambda: f"{between(0, 24):02}:{between(0, 60):02}:{between(0, 60):02}",
        lambda: pick(["$", "€", "£", "price ", "usd "]) + f"{between(1, 999)},{digits(3)}.{digits(2)}",
        lambda: pick(["$", "€", "total ", "cost "]) + digits(between(7, 11)),
        lambda: pick(["order ", "ticket #", "issue ", "invoice no. ", "item ", "part number ", "serial "]) + digits(between(7, 13)),
        lambda: "isbn " + pick([digits(13), digits(3) + "-" + digits(1) + "-" + digits(4) + "-" + digits(4) + "-" + digits(1)]),
        lambda: pick(["commit ", "sha256: ", "md5 ", "checksum ", "revision ", "digest: "]) + chars(hexa, pick([32, 40, 64])),
        lambda: pick(["ratio: ", "note: ", "a = ", "x=", "key: value ", "section "]) + word() + " " + digits(between(1, 5)),
        lambda: "section " + ".".join(digits(1) for _ in range(between(3, 5))),
        lambda: word() + "-" + word() + "-" + word() + digits(between(1, 3)),
        lambda: f"{digits(1)} {digits(1)} {digits(2)} {digits(2)} {digits(1)} {digits(2)}",
        lambda: " ".join(digits(between(1, 4)) for _ in range(between(4, 9))),
        lambda: digits(between(1, 7)) + pick([" ", ", ", "-"]) + digits(between(1, 4)),
        lambda: "@" + word() + " " + word() + "@ " + word(),
        lambda: "rfc " + digits(4) + "-" + digits(4),
    ]
    out = []
    for i in range(count):
        text, spans = words(between(1, 12)) + pick([" ", " ", ", ", ". "]), []
        if i % 2:
            head, value, tail = (made := pick(private[:6] * 2 + private))()
            if rng.random() < 0.2 and made is not private[-1]:
                head = pick(["order ", "page ", "version ", "total ", "item ", "hash ", "on ", "no. "]) + head
            text += head
            spans.append((len(text), len(text) + len(value)))
            text += value + tail
        else:
            text += pick(plain)()
        out.append((text + pick([" ", ", ", ". ", "\n"]) + words(between(1, 8)), spans))
    return out


@dataclass
class Model:
    trees: Trees
    thresholds: np.ndarray

    def redactions(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans to redact in each text, apart and in order."""
        found = [candidates(t) for t in texts]
        rows = [features(t, *c) for t, cs in zip(texts, found) for c in cs]
        if not rows:
            return [[] for _ in texts]
        score = self.trees.score(np.array(rows, np.float64))
        out, at = [], 0
        for cs in found:
            mine = score[at : at + len(cs)]
            at += len(cs)
            out.append(united([(s, e, KINDS[k], float(z)) for (s, e, k), z in zip(cs, mine) if z >= self.thresholds[k]]))
        return out


def united(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Overlapping spans become one, under the kind of the best score (ties: the longer, then the first)."""
    out: list[list] = []
    for s, e, kind, z in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if out and s < out[-1][1]:
            last = out[-1]
            if (z, e - s) > last[3]:
                last[2], last[3] = kind, (z, e - s)
            last[1] = max(last[1], e)
        else:
            out.append([s, e, kind, (z, e - s)])
    return [(s, e, k) for s, e, k, _ in out]


def _labelled(made):
    x, y, kinds = [], [], []
    for text, spans in made:
        for s, e, k in candidates(text):
            inside = [max(0, min(e, b) - max(s, a)) / max(e - s, b - a) for a, b in spans]
            best = max(inside, default=0)
            if 0.3 < best < 0.8:
                continue  # neither quite the span nor quite not
            x.append(features(text, s, e, k))
            y.append(float(best >= 0.8))
            kinds.append(k)
    return np.array(x), np.array(y), np.array(kinds)


def fit(count: int = EXAMPLES, seed: int = SEED) -> Model:
    """Trees on three quarters of the examples; thresholds on the rest.

    A kind's threshold is the highest that keeps RECALL of its held-out private
    spans, moved half-way down to the best look-alike below it.
    """
    made = examples(count, seed)
    cut = len(made) * 3 // 4
    x, y, _ = _labelled(made[:cut])
    trees = Trees().fit(x, y)
    hx, hy, hk = _labelled(made[cut:])
    score = trees.score(hx)
    limits = np.zeros(len(KINDS))
    for k in range(len(KINDS)):
        good, bad = np.sort(score[(hk == k) & (hy > 0)]), score[(hk == k) & (hy == 0)]
        if len(good):
            top = good[int((1 - RECALL) * len(good))]
            under = bad[bad < top]
            limits[k] = (top + (under.max() if len(under) else top - 4)) / 2
    return Model(trees, limits)


def _redact(model: Model, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(redacted texts, redactions in each) of a run of documents."""
    raw, offsets, _ = B.text_buffers(column)
    anchors = np.flatnonzero(_ANCHOR_BYTE[raw])
    some = np.unique(np.searchsorted(offsets, anchors, side="right") - 1)
    count, new = np.zeros(len(column), np.int64), {}
    for a in range(0, len(some), 256):
        part = some[a : a + 256].tolist()
        texts = [bytes(raw[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace") for i in part]
        for i, text, found in zip(part, texts, model.redactions(texts)):
            if found:
                bits, last = [], 0
                for s, e, kind in found:
                    bits += [text[last:s], f"[{kind}]"]
                    last = e
                new[i], count[i] = "".join(bits) + text[last:], len(found)
    if new:
        mask = np.zeros(len(column), bool)
        mask[list(new)] = True
        column = pc.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in sorted(new)], column.type))
    return column, count


def _runs(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of documents of bounded text: what is worked out for one doesn't grow with the batch."""
    for i, j in B.doc_chunks(B.text_buffers(batch.column(at))[1]):
        yield batch.slice(i, j - i)


def redact_pii(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_redacted) of each row: the whole text with private spans replaced by [KIND].

    A null text stays null with a count of 0; an empty one stays empty.
    Repeated rows are treated each; other columns aren't read.  Overlapping
    spans become one, so no part of one is left.  An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch, 1):
                text, count = _redact(shared.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), text, pa.array(count)], [id_col, text_col, "n_redacted"])

    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    return wanted.mapInArrow(trimmed(run), f"`{id_col}` {wanted.schema[0].dataType.simpleString()}, `{text_col}` string, n_redacted long")


def redact_column(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its text redacted and all its columns; ``length_col``, where there is one, follows the text.

    A null text stays null, and its length is then null; an empty one stays
    empty.  Repeated rows are treated each, alike.  Overlapping spans become
    one.  An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch, at):
                text, _ = _redact(shared.value, part.column(at))
                yield part.set_column(at, part.schema.field(at), text)

    out = docs.mapInArrow(trimmed(run), docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType)).select(*docs.columns)
    return out
