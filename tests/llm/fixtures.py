"""Small tables with everything that tends to break: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SYLLABLES = {"en": ["the", "ing", "an", "her", "st", "tion"], "de": ["der", "sch", "ung", "ein", "ch", "ü"], "fr": ["eau", "é", "qui", "ment", "ou", "le"]}
NAMES = "doc_id long, text string, lang string, row long, node long, score double, key string, size int, bucket int, flush long"


def words(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(5)
    rows: list[tuple[int | None, str | None, str | None]] = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, words(rng, lang, rng.randint(1, 120)), lang))
    base = words(rng, "en", 200)
    rows += [(100 + k, base, "en") for k in range(4)]  # exact copies
    for k in range(6):  # near copies
        w = base.split()
        w[20 * k] = "changed"
        rows.append((110 + k, " ".join(w), "en"))
    rows += [(120, "four words are short", "en"), (121, "Four WORDS are\tshort", "en"), (122, "one", None)]
    rows += [(130, None, "en"), (131, "", "de"), (132, " \n\t ", "fr"), (133, "12 34 !?", "en"), (None, "no id here at all, but some words", "en")]
    rows += [(140, words(rng, "de", 30_000), "de")]  # very long
    rows += [(5, rows[5][1], "fr")] * 2  # repeated rows
    rows += [(7, "the same id with another text", "en")]
    return rows


def documents(spark: SparkSession, rows=None) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, lang, -1, -2, 0.5, "k", 3, 4, 5) for i, t, lang in rows], NAMES).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NAMES)
