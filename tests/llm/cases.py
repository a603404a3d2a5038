"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Extra columns whose names operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double, cell int, stats string,"
    " quality_stats string, toxic_score double, rep long, unit string, component_id long, length long, number long"
)


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7))) for _ in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, base),
        (5, base),
        (6, base + " tail"),
        (7, prose(2, 30_000)),
        (8, "one"),
        (9, "One"),
        (10, "x " * 5000),
        (11, "naïve ́ ﬁ 漢字 😀 \x1c <|endoftext|> 'S ½"),
        (12, prose(3, 60)),
        (12, prose(3, 60)),
        (None, "without id " + prose(4, 40)),
        (None, None),
    ]


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    rows = texts() if rows is None else rows
    full = [(i, t, "en", "s", None, 7, 0.5, 1, "x", "y", 0.1, 3, "u", 4, 5, 6) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
