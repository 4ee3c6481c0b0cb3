"""Deterministic detectors: an emitter without weights.

They are rules for structured data (addresses of mail and net, telephone and
card numbers, keys), not a trained model, and know nothing of names or
postal addresses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.offsets import BYTES, _col, size

#: (label, pattern) by falling precedence.  They hold only what Java and RE2 read alike.
RULES: tuple[tuple[str, str], ...] = (
    ("private_email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("private_url", r"https?://[^\x00-\x20\x22'<>]+"),
    ("secret", r"\b(?:[0-9a-f]{40}|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36})\b"),
    ("account_number", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"),
    ("private_phone", r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}\b"),
    ("IPADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("private_date", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"),
)

#: A string that every match of a pattern holds.
MUST_HOLD = {RULES[0][1]: "@", RULES[1][1]: "://"}


def matches(text, label: str, pattern: str, unit: str = BYTES) -> Column:
    """Array of (start, end, score, label) of a pattern's matches.

    What lies between two matches and the matches themselves part the text, so
    their lengths give the offsets.
    """
    found, gaps = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)), F.split(_col(text), pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(size(g, unit).alias("gap"), size(m, unit).alias("n")))
    none = F.array().cast("array<struct<start:int,end:int,score:float,label:string>>")

    def step(acc, p):
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["n"]).alias("end"), F.lit(1.0).cast("float").alias("score"), F.lit(label).alias("label"))
        return F.struct((start + p["n"]).alias("at"), F.array_append(acc["out"], span).alias("out"))

    # a search for a fixed string is far cheaper than a pattern that begins with a repeated class
    some = _col(text).rlike(pattern)
    if pattern in MUST_HOLD:
        some = F.contains(_col(text), F.lit(MUST_HOLD[pattern])) & some
    return F.when(some, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).when(_col(text).isNotNull(), none)


def rule_spans(text, rules=RULES, unit: str = BYTES) -> Column:
    """The spans of all rules, by rule, then by place; they may overlap."""
    return F.concat(*(matches(text, label, pattern, unit) for label, pattern in rules))
