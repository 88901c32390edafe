"""The filter audit against playing every order document by document."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from inversia.llm import filteraudit
from inversia.llm.filteraudit import Transducer
from inversia.llm.queries import ORACLES, QUERIES
from tests.llm.messy import FOLDER, empty, messy
from tests.oracle import connect, difference

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)


def plain_audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = {}
    for i, text, source in rows:
        w, different, capitals, symbols, n = plain_counts(text or "")
        fails = {k for k, bad in zip("ABCDE", (w < 50, 100 * different < 65 * w, 100 * capitals > 5 * n, symbols > 0, i is not None and first[text or ""] < i)) if bad}
        parts.setdefault(source or "", []).append((frozenset(fails), i is not None and i in good, i is not None and i in toxic))
    out = []
    for part, documents in parts.items():
        lines, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = list(documents)
            for step, k in enumerate(order, 1):
                gone = [d for d in left if k in d[0]]
                left = [d for d in left if k not in d[0]]
                again = sum(k in d[0] for d in documents) - len(gone)
                shapley[k] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), again, sum(d[0] == {k} for d in documents), sum(d[1] for d in gone), sum(d[2] for d in gone), k))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


@pytest.mark.parametrize("window", [1, 2, 7, 1 << 20])
def test_transducer_at_any_window(window):
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["a", "B", "Z", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "é", "中", "🙂", "#", "|", "\x00", "ab"]) for _ in range(rng.randrange(40)))
        assert Transducer(window).read(text.encode()) == plain_counts(text)
    long_word = "x" * 50 + " " + "x" * 50
    assert Transducer(window).read(long_word.encode()) == plain_counts(long_word)


def labelled(spark, rows):
    return spark.createDataFrame([(i, q, t, "extra") for i, q, t in rows], "doc_id long, quality int, toxic int, part string")


def test_odd_documents(spark):
    docs = messy(spark)
    ids = sorted({r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None})
    marks = [(i, n % 2, n % 3 == 0 and 1 or None) for n, i in enumerate(ids)] + [(ids[0], None, 1), (None, 1, 1), (10**9, 1, 1), (ids[1], 1, 0), (ids[1], 0, 0)]
    got = filteraudit.audit(docs, labelled(spark, marks))
    assert got.columns == COLUMNS
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, marks)
    assert got.count() == 600 * len({s or "" for _, _, s in rows})


def test_every_mask_and_a_hot_text(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, n % 40]), "the same text " * 30, rng.choice(["s", None, ""])) for n in range(200)]
    for n in range(400):
        words = [f"w{k}" for k in range(rng.choice([10, 80]))] * rng.choice([1, 3])
        text = " ".join(words) + rng.choice(["", " #"]) + rng.choice(["", " " + "Q" * 60])
        rows.append((rng.randrange(500), text, rng.choice(["s", "t", None])))
    marks = [(n, rng.randrange(2), rng.randrange(2)) for n in range(0, 500, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert sorted(map(tuple, filteraudit.audit(docs, labelled(spark, marks)).collect())) == plain_audit(rows, marks)


def test_empty_tables(spark):
    assert filteraudit.audit(empty(spark), labelled(spark, [])).collect() == []
    some = messy(spark)
    found = filteraudit.audit(some, labelled(spark, []))
    assert found.agg({"good_lost": "max"}).first()[0] == 0 and found.count() > 0


def test_query_against_sql(spark):
    assert difference(QUERIES["op13_filter_audit"](spark, FOLDER), connect(FOLDER), ORACLES["op13_filter_audit"]) is None
