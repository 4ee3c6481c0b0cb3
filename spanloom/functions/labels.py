"""Labels of spans: redaction tags, targets, BIOES classes and training aliases.

All of it is data, so that a mismatch between two of the maps stays visible.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The eight labels that datasets and reports use.
TARGETS = tuple("account_number private_address private_date private_email private_person private_phone private_url secret".split())
OTHER_TAG = "[REDACTED]"

_TAGS = {
    "PERSON": "private_person JOBTITLE LASTNAME MIDDLENAME FIRSTNAME",
    "ADDRESS": "private_address CITY COUNTY STATE STREET ZIPCODE SECONDARYADDRESS BUILDINGNUMBER",
    "EMAIL": "private_email EMAIL",
    "PHONE": "private_phone PHONENUMBER PHONE",
    "DATE": "private_date TIME AGE DATEOFBIRTH DATE",
    "URL": "private_url URL",
    "SECRET": "secret PASSWORD",
    "ACCOUNT": "account_number AMOUNT HEIGHT MAC IPADDRESS VRM BIC CREDITCARDNUMBER CVV PIN SSN IBAN USERNAME ACCOUNTNAME BANKACCOUNT ACCOUNTNUMBER",
}
REDACTION_TAGS: dict[str, str] = {label: f"[{tag}]" for tag, labels in _TAGS.items() for label in labels.split()}

_SOURCES = {
    "private_person": "PREFIX LASTNAME MIDDLENAME FIRSTNAME",
    "private_address": "ZIPCODE STREET STATE SECONDARYADDRESS COUNTY CITY BUILDINGNUMBER",
    "private_date": "TIME DATEOFBIRTH DATE",
    "private_email": "E_MAIL EMAILADDRESS EMAIL",
    "private_phone": "TELEPHONENUMBER PHONE_NUMBER PHONENUMBER PHONE",
    "private_url": "URI URL",
    "account_number": "IBAN BANK_ACCOUNT BANKACCOUNT ACCOUNT_NUMBER ACCOUNTNUMBER ACCOUNT",
    "secret": "BEARER PASSWORD TOKEN API_KEY APIKEY SECRET",
}
#: Fine-grained labels to targets; a label that isn't here is dropped by a remap.
REMAP: dict[str, str] = {**{t: t for t in TARGETS}, **{label: target for target, labels in _SOURCES.items() for label in labels.split()}}

#: Categories that a classifier may already know, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {k: tuple(v.split()) for k, v in {"secret": "PASSWORD", "private_url": "URL", "private_phone": "PHONE", "private_email": "EMAIL", "private_date": "DATE DATEOFBIRTH", "account_number": "BANKACCOUNT ACCOUNTNAME"}.items()}


def map_column(values: Mapping[str, str]) -> Column:
    return F.create_map([F.lit(x) for kv in sorted(values.items()) for x in kv])


def redaction_tag(label: Column) -> Column:
    """The tag in brackets that stands for a label."""
    return F.coalesce(F.element_at(map_column(REDACTION_TAGS), label), F.lit(OTHER_TAG))


def remap(label: Column) -> Column:
    """The target of a label; null where it has none."""
    return F.element_at(map_column(REMAP), label)


def tag_table(spark: SparkSession) -> DataFrame:
    """(label, tag) as a dimension table."""
    return spark.createDataFrame(sorted(REDACTION_TAGS.items()), "label string, tag string")


def remap_table(spark: SparkSession) -> DataFrame:
    """(label, target) as a dimension table."""
    return spark.createDataFrame(sorted(REMAP.items()), "label string, target string")


O, B, I, E, S = range(5)


@dataclass(frozen=True)
class LabelTable:
    """Class labels of a token classifier, taken apart."""

    labels: tuple[str, ...]
    tag: tuple[int, ...]
    category: tuple[int, ...]
    categories: tuple[str, ...]
    o_label: int
    begin: tuple[int, ...]
    inside: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(class_id, label, tag, cat_id, category)."""
        rows = [(i, x, "OBIES"[t], c, self.categories[c] if c >= 0 else None) for i, (x, t, c) in enumerate(zip(self.labels, self.tag, self.category))]
        return spark.createDataFrame(rows, T.StructType.fromDDL("class_id int, label string, tag string, cat_id int, category string"))


def label_table(labels: Sequence[str]) -> LabelTable:
    """The first letter is the tag, what follows the first hyphen the category.

    Empty labels and those of another first letter count as O.  A label
    without a hyphen is its own category.  Categories are numbered as they come.
    """
    tags, cats, names = [], [], {}
    for x in labels:
        t = "OBIES".find(x[0]) if x and x != "O" else O
        if t <= O:
            tags.append(O)
            cats.append(-1)
            continue
        name = x.partition("-")[2] if "-" in x else x
        tags.append(t)
        cats.append(names.setdefault(name, len(names)))
    begin, inside = [-1] * len(names), [-1] * len(names)
    for k, (t, c) in enumerate(zip(tags, cats)):
        if t == B:
            begin[c] = k
        elif t == I:
            inside[c] = k
    first_o = next((k for k, x in enumerate(labels) if x in ("", "O")), 0)
    return LabelTable(tuple(labels), tuple(tags), tuple(cats), tuple(names), first_o, tuple(begin), tuple(inside))


def resolve_category(category: str, labels: set[str] | Mapping[str, int]) -> str:
    """The category itself if all four of its rows are known, else the first known alias, else itself."""
    known = lambda c: all(f"{t}-{c}" in labels for t in "BIES")
    return next((c for c in (category, *ALIASES.get(category, ())) if known(c)), category)


def extend_labels(labels: Sequence[str], targets: Sequence[str] = TARGETS) -> list[str]:
    """``labels`` with the BIOES labels of unresolved targets behind them, as far as they aren't there."""
    have = set(labels)
    more = [f"{t}-{c}" for c in targets if resolve_category(c, have) == c for t in "BIES"]
    return [*labels, *(x for x in more if x not in have)]


def extend_head(weight, bias, labels: Sequence[str], targets: Sequence[str] = TARGETS, seed: int = 0):
    """(weight, bias, labels) of a classifier's last layer with rows for the labels that ``extend_labels`` adds.

    Rows that there were stay as they are; new ones are small and random from
    the seed, their biases 0.
    """
    import numpy as np

    names = extend_labels(labels, targets)
    more = len(names) - len(labels)
    rows = np.random.default_rng(seed).normal(0, 0.02, (more, weight.shape[1]))
    return np.concatenate([weight, rows.astype(weight.dtype)]), np.concatenate([bias, np.zeros(more, bias.dtype)]), names
