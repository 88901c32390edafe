"""Leaks against SQL, and against brute force on odd rows."""

import pytest

from inversia.llm import decontaminate, queries
from tests.llm.messy import FOLDER, documents, empty, messy, sentence
from tests.oracle import connect, difference


def plain(docs, items, threshold=0.8, k=5):
    def shingles(text, width):
        w = (text or "").lower().encode().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    out = set()
    for d, text in docs:
        for item, own in items:
            width = min(k, len((own or "").encode().split()))
            if width:
                s = shingles(own, width)
                n = len(s & shingles(text, width))
                if n >= threshold * len(s):
                    out.add((d, item, len(s), n, n / len(s)))
    return out


ITEMS = "item_id long, text string, row string, words string, h long"


def items(spark):
    import random

    rng = random.Random(6)
    texts = [sentence(rng, n) for n in (12, 33, 60)] + ["one", "the the the", "Two WORDS", None, "", " ", "nowhere to be found at all in here"]
    return [(i if i != 3 else None, t) for i, t in enumerate(texts)]


def odd_documents(spark):
    import random

    rng = random.Random(8)
    own = [t for _, t in items(spark)]
    texts = [own[0], "x " + own[1].upper().replace(" ", "\n") + " y", own[2][:300], own[2][: int(len(own[2]) * 0.9)], sentence(rng, 20_000) + " " + own[1] + " " + sentence(rng, 100)]
    extra = [(900 + i, t) for i, t in enumerate(texts)] + [(900, own[0]), (901, own[0]), (None, own[1])]
    rows = spark.createDataFrame(extra, "doc_id long, text string")
    return messy(spark).unionByName(rows, allowMissingColumns=True)


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_odd_rows(spark, threshold):
    df = odd_documents(spark)
    table = spark.createDataFrame([(a, b, "r", "w", 1) for a, b in items(spark)] * 2, ITEMS)
    found = decontaminate.find_leaks(df, table, threshold=threshold)
    got = [(r.key, r.item, r.n_shingles, r.n_shared, r.containment) for r in found.collect()]
    want = plain({(r.doc_id, r.text) for r in df.collect()}, items(spark), threshold)
    assert set(got) == want and len(want) > 5


def test_joins_that_are_not_broadcast_agree(spark, monkeypatch):
    df = odd_documents(spark)
    table = spark.createDataFrame([(a, b, "r", "w", 1) for a, b in items(spark)], ITEMS)
    a = set(map(tuple, decontaminate.find_leaks(df, table).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", -1)
    assert set(map(tuple, decontaminate.find_leaks(df, table).collect())) == a


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) is None


def test_rows_without_leaks_stay(spark):
    df = odd_documents(spark)
    table = spark.createDataFrame(items(spark), "item_id long, text string")
    kept = decontaminate.drop_leaks(df, table)
    leaking = {text for text in {r.text for r in df.collect()} if plain([(0, text)], items(spark))}
    assert kept.columns == df.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in df.collect() if r.text not in leaking)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(documents(spark), none).collect() == []
    assert decontaminate.drop_leaks(documents(spark), none).count() == documents(spark).count()
    some = spark.createDataFrame(items(spark), "item_id long, text string")
    assert decontaminate.leaks(empty(spark), some).collect() == [] and decontaminate.drop_leaks(empty(spark), some).collect() == []
