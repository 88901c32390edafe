"""How filters interact: what each removes first, again, or alone, under every order of them.

A table-driven transducer reads the UTF-8 bytes of a text once. A table gives each byte its class
(separator, capital, symbol, first byte of a character); the machine has two states, inside and
outside of a word, and the class of a byte alone decides which one follows, so that numpy can step
through a whole window of bytes at once. It counts words, capitals, symbols and code points, and
emits the span of each word, which goes into a hash table that compares the bytes of every entry it
meets again; so the number of different words is exact.

What the five filters say of a text is a mask of five bits. Everything the report needs follows
from the number of documents per part and mask, so the orders are played on those counts alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.llm.workspace import Workspace, bytes_of

FILTERS = "ABCDE"
#: The bounds of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
#: Bytes stepped through at once.
WINDOW = 1 << 20
#: Salts of rows without an id, which no label can meet.
SPREAD = 1 << 12

SEPARATOR, CAPITAL, SYMBOL, CHARACTER = 1, 2, 4, 8


def byte_classes() -> np.ndarray:
    """The class bits of each of the 256 bytes."""
    table = np.zeros(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] |= SEPARATOR
    table[ord("A") : ord("Z") + 1] |= CAPITAL
    table[list(SYMBOLS)] |= SYMBOL
    table[[b for b in range(256) if not 0x80 <= b < 0xC0]] |= CHARACTER
    return table


class Transducer:
    """Counts over one text after another."""

    def __init__(self, window: int = WINDOW):
        self.table, self.window = byte_classes(), window

    def read(self, text: bytes) -> tuple[int, int, int, int, int]:
        """Words, different words, capitals, symbols and code points of a text."""
        words = capitals = symbols = characters = 0
        seen: set[bytes] = set()
        open_: list[bytes] = []  # the pieces of a word that goes on in the next window
        for a in range(0, len(text), self.window):
            data = text[a : a + self.window]
            classes = self.table[np.frombuffer(data, np.uint8)]
            capitals += int(np.count_nonzero(classes & CAPITAL))
            symbols += int(np.count_nonzero(classes & SYMBOL))
            characters += int(np.count_nonzero(classes & CHARACTER))
            inside = np.zeros(len(classes) + 2, np.int8)
            inside[1:-1] = (classes & SEPARATOR) == 0
            turns = np.flatnonzero(np.diff(inside))
            starts, ends = turns[::2].tolist(), turns[1::2].tolist()
            if open_ and (not starts or starts[0]):  # it ended with the window before
                words += 1
                seen.add(b"".join(open_))
                open_ = []
            if open_ and ends[0] < len(data):
                words += 1
                seen.add(b"".join([*open_, data[: ends[0]]]))
                open_, starts, ends = [], starts[1:], ends[1:]
            if ends and ends[-1] == len(data) and a + self.window < len(text):
                open_.append(data[starts[-1] :])
                starts, ends = starts[:-1], ends[:-1]
            elif open_:  # the last window ends inside the word that it began in
                words += 1
                seen.add(b"".join([*open_, data]))
                open_, starts, ends = [], [], []
            words += len(starts)
            seen.update(map(data.__getitem__, map(slice, starts, ends)))
        return words, len(seen), capitals, symbols, characters


def failures(words: int, different: int, capitals: int, symbols: int, characters: int) -> int:
    """The bits of filters A to D that a text fails."""
    return (
        (words < LEAST_WORDS)
        | (100 * different < LEAST_DISTINCT * words) << 1
        | (100 * capitals > MOST_CAPITALS * characters) << 2
        | (symbols > 0) << 3
    )


def judged(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``key``, ``part`` (null: empty), ``mask`` (bits of the failed filters A to D) and ``digest``
    (SHA-256 of the text, null as empty) of every row."""
    narrow = df.select(df[key].alias("key"), F.coalesce(df[part].cast("string"), F.lit("")).alias("part"), df[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer()
        for batch in batches:
            masks, digests = [], []
            for body in bytes_of(batch.column(2)):
                body = body or b""
                masks.append(int(failures(*machine.read(body))))
                digests.append(hashlib.sha256(body).digest())
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "part", "mask", "digest"])

    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, part string, mask int, digest binary")


def _cells(docs: DataFrame, labels: DataFrame, space: Workspace, key: str, text: str, part: str) -> DataFrame:
    """``part``, ``mask`` (all five filters), ``good``, ``toxic`` (0 or 1) and ``n`` documents."""
    # equal rows are counted where they are read; what moves has no text
    counted = judged(docs, key, text, part).groupBy("digest", "key", "part", "mask").agg(F.count("*").alias("n"))
    counted = space.keep(counted, "judged")
    # the holder of a text is its smallest id; one row for each text and task moves
    holders = counted.where(F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("key"))
    holders = space.keep(holders.withColumn("holds", F.lit(True)), "holders")
    counted = counted.join(holders, ["digest", "key"], "left")
    copies = F.col("key").isNotNull() & F.col("holds").isNull()
    counted = counted.withColumn("mask", F.col("mask") + F.when(copies, F.lit(1 << 4)).otherwise(0))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    marks = space.keep(marks.withColumn("salt", F.lit(0)), "labels")
    # rows without an id meet no label, wherever they go
    salt = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD)).cast("int")).otherwise(0)
    joined = counted.withColumn("salt", salt).join(marks, ["key", "salt"], "left")
    marked = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    return joined.select("part", "mask", *marked, "n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _steps() -> tuple[list[tuple[int, int]], list[tuple[str, int, int, int]]]:
    """The pairs (filter, set of filters before it), and for every order its steps."""
    pairs = [(f, before) for f in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before >> f & 1]
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            steps.append(("".join(FILTERS[k] for k in order), i + 1, f, before))
            before |= 1 << f
    return pairs, steps


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``: one row per part, order of the five filters and step of that order.

    Filters: under 50 words; under 65 different words of 100; over 5 capitals A-Z of 100 code
    points; any of ``#$%&*|``; the text of a smaller id, anywhere in the table, removed or not. Null
    texts are empty texts. A null id is neither smaller nor larger than another: such a row is no
    copy and makes none. Rows of one id don't make each other copies, and repeated rows all count.
    An id is good or toxic if any of its ``labels`` rows says so; ids without labels are neither, as
    are null ids. A null part counts with the empty one. Labels of no document say nothing; an empty
    table of documents gives no rows. Other columns aren't read.

    One pass over the texts; what is shuffled has a digest, an id and a part per document. Rows of
    one text meet in partial sums only, rows of one id and text are counted first."""
    space = Workspace(docs.sparkSession, "audit")
    cells = space.keep(_cells(docs, labels, space, key, text, part), "cells")
    pairs, steps = _steps()
    pair = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before")) for f, b in pairs])
    fails = F.expr("(mask & shiftleft(1, filter)) <> 0")
    earlier = F.expr("(mask & before) <> 0")
    alone = F.expr("mask = shiftleft(1, filter)")

    def total(condition, of="n"):
        return F.coalesce(F.sum(F.when(condition, F.col(of))), F.lit(0)).cast("long")

    tallied = cells.withColumn("pair", F.explode(pair)).select("*", "pair.filter", "pair.before").groupBy("part", "filter", "before").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(alone).alias("unique_fails"),
        total(fails & ~earlier & (F.col("good") == 1)).alias("good_lost"),
        total(fails & ~earlier & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    tallied = space.keep(tallied, "tallied")
    # so many orders put exactly these filters before this one
    rest = len(FILTERS) - 1
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(rest - k)) for k in range(rest + 1)]), F.bit_count("before") + 1)
    shares = tallied.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    step = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    report = tallied.join(shares, ["part", "filter"]).join(F.broadcast(step), ["filter", "before"])  # 600 rows, whatever the data
    return report.select("part", "filter_order", "step", *counts, "shapley")
