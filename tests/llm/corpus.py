"""Small tables with the cases every operator must take."""

from __future__ import annotations

import re

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPACES.split(text or "") if w]


def lower_words(text: str | None) -> list[str]:
    return words((text or "").translate(LOWER))


def sentence(seed: int, n: int) -> str:
    """Words that look alike but rarely repeat in a row."""
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k * 17) % 997}" for k in range(n))


LONG = sentence(1, 30_000)
NEAR = sentence(5, 200)

#: doc_id, text, source: nulls, empty and very long texts, ties, repeated rows
DOCUMENTS = [
    (1, "The  cat\tsat on the mat, and\nthe dog too.", "b"),
    (2, "The cat sat on the mat, and the dog too.", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, " \t\n ", "a"),
    (6, "one two three", "b"),
    (7, "ONE two three", "c"),
    (8, LONG, "c"),
    (9, LONG + " tail", "a"),
    (10, NEAR, "a"),
    (11, NEAR + " extra words here", "b"),
    (12, "start " + NEAR, None),
    (13, sentence(9, 120), "b"),
    (14, sentence(11, 120), "b"),
    (14, sentence(11, 120), "b"),
    (15, "naïve café Ünïcode \U0001f600 x y <|endoftext|> don't!,", "é"),
    (None, "no id at all", "z"),
]


def documents(spark, rows=None, clashing: bool = False):
    frame = spark.createDataFrame(DOCUMENTS if rows is None else rows, "doc_id bigint, text string, source string")
    if clashing:
        from pyspark.sql import functions as F

        names = "size key slice row cls n component component_id keep_id again score class rank target held_out value document _id hash shard".split()
        frame = frame.select("*", *[F.lit(7).alias(n) for n in names])
    return frame
