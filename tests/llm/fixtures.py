"""Small hard tables: nulls in any column, empty, blank and long texts, ties, repeated rows, columns of clashing names."""

import random

from noemata.llm.common import DOCUMENT_COLUMNS

WORDS = ["the", "of", "and", "river", "stone", "éclair", "größe", "niño", "walk", "under", "light", "mörk", "tablet", "green", "quiet", "Loud", "B", "x9", "...", "###"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    out = []
    for i in range(n):
        text = sentence(rng, rng.randint(0, 90))
        if i % 4 == 0:
            text = f"{sentence(rng, 9)}\n{passage}\n{sentence(rng, 7)}"
        if i % 7 == 0:
            text = passage + " " + passage
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), len(text)))
    out += [(100, None, "en", "b", None), (101, "", None, None, 0), (102, " \t\n ", "fr", "a", 4), (103, "word " * 30_000, "en", "a", 150_000), (104, "é" * 50_001, None, "b", 50_001)]
    out += [out[0], out[0], (None, "no id at all, " + passage, None, None, 5)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("size", "target", "copies", "kept", "votes", "posterior", "print", "component", "doc", "spans", "row", "word", "c0", "_text", "taken", "source_key", "n", "count")


def frame(spark, rows=None, extra=False):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.select(*DOCUMENT_COLUMNS, *[F.lit(7).alias(c) for c in CLASHING])
    return df
