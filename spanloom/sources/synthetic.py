"""Made-up inputs for benchmarks and tests, the same on every run."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks that hold what tokenisers find hard.
_BLOCKS = ((0x20, 0x7E), (0xA0, 0x17F), (0x300, 0x36F), (0x400, 0x4FF), (0x600, 0x6FF), (0x900, 0x97F), (0x2000, 0x206F), (0x3040, 0x30FF), (0x4E00, 0x4FFF), (0xAC00, 0xACFF), (0xFF00, 0xFF60), (0x1F300, 0x1F64F))


def pii_documents(spark: SparkSession, rows: int, paragraphs: int = 1) -> DataFrame:
    """(doc_id, text): numbered paragraphs, each with a mail address, a telephone number, a card and a date."""
    one = lambda k: F.format_string(
        "Note %d: clerk no. %d can be written to at clerk%d@mail%d.example or rung on +1 (%03d) 555-%04d; card 4000 0000 %04d %04d, filed on 20%02d-%02d-%02d.",
        k, k, k, k % 17, k % 900 + 100, k % 10000, k % 10000, (k * 7) % 10000, k % 30, k % 12 + 1, k % 28 + 1,
    )
    base = F.transform(F.sequence(F.lit(0), F.lit(paragraphs - 1)), lambda p: one((F.col("id") * paragraphs + p).cast("int")))
    return spark.range(rows).select(F.col("id").alias("doc_id"), F.array_join(base, "\n\n").alias("text"))


def random_text(seed: int, most: int = 200) -> str:
    """Random text over many scripts."""
    r = random.Random(seed)
    out = []
    for _ in range(r.randrange(most + 1)):
        lo, hi = r.choice(_BLOCKS)
        out.append(r.choice([" ", "\n", "\r\n", "\t", "'s", chr(r.randint(lo, hi)), chr(r.randint(lo, hi))]))
    return "".join(out)


_NAMES = ("Ada", "Björn", "Carmen", "Dagny", "Emre", "Fanny", "Goran", "Hedda", "Ivo", "Juno")
_FAMILIES = ("Aalto", "Brandão", "Cieślak", "Dubois", "Eriksen", "Færøy", "Gómez", "Horváth")
_PLACES = ("Aarhus", "Brno", "Cádiz", "Delft", "Évora", "Graz")


def letters(paragraphs: int = 90, seed: int = 11) -> str:
    """One long text: numbered letters with names, addresses, telephone and account numbers in several scripts' spelling, parted by blank lines."""
    r = random.Random(seed)
    out = []
    for k in range(paragraphs):
        name, family = r.choice(_NAMES), r.choice(_FAMILIES)
        out.append(
            f"Letter no. {k}, from {name} {family}, {r.randint(1, 99)} {r.choice(_PLACES)} Road: my parcel of 20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} is lost. "
            f"Write to {name.lower()}{k}@post{r.randint(1, 9)}.example or ring +{r.randint(1, 48)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}; "
            f"pay to {' '.join(str(r.randint(1000, 9999)) for _ in range(4))}, please, and note that {r.choice(('mornings', 'evenings', 'Sundays'))} are best."
        )
    return "\n\n".join(out)
