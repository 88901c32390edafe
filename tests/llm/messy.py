"""Documents with every kind of trouble, and whole small tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

FOLDER = "/root/testdata/sf0.001"
# further columns named like what operators use inside or return
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, key long, size int, shard string, slot int, fp long, h string, count int, score double, t1 long, copies int"
)


def sentence(rng: random.Random, n: int) -> str:
    words = "the of and cat dog house tree river stone cloud light paper green silver old new warm cold".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", "ly", "."]) for _ in range(n))


def messy_rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    base = [sentence(rng, n) for n in (3, 30, 80, 200)]
    long_text = sentence(rng, 30_000)
    texts = [
        None, "", " ", "\n\t ", "one", "two words", "the the the", "é ß 中文 🙂", "ŽŠ x y", "%%% $$$ 123", "a" * 5000,
        base[0], base[1], base[1], base[2], base[2] + " more", base[3], base[3].upper(), base[3][:400] + " changed " + base[3][400:], long_text, long_text + " end",
    ]
    rows = []
    for i, text in enumerate(texts):
        rows.append((i * 3 + 1, text, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3 if i % 4 else 0], None if i % 5 == 0 else len(text or "")))
    rows.append((None, base[1], None, None, None))
    rows.append((None, None, None, None, None))
    rows += [rows[12], rows[12], rows[16]]  # repeated rows
    rows.append((rows[16][0], "another text for a repeated id", "en", "s1", 30))
    extra = ("r", 7, 9, "old", 4, 1, "x", 2, 0.5, 3, 8)
    return [r + extra for r in rows]


def messy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
