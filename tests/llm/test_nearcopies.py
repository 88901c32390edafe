"""Classes of near copies against all pairs of five-word sets."""

import random
from itertools import combinations
from pathlib import Path

from inversia.llm import nearcopies
from tests.llm.messy import empty, messy, sentence


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain_classes(texts, threshold=0.8):
    """The smallest place in ``texts`` that links reach, by comparing all pairs."""
    sets = [plain_set(t) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = 0
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) >= threshold * max(len(a), len(b)) - 1e-9 and (a == b or len(a & b) >= threshold * len(a | b) - 1e-9):
            pairs += a != b
            x, y = sorted((top(i), top(j)))
            label[y] = x
    return [top(i) for i in range(len(texts))], pairs


def same_classes(got, want):
    """Two lists of class names that cut the same rows into the same classes."""
    return len(set(zip(got, want))) == len(set(got)) == len(set(want))


def check(spark, df, key="doc_id"):
    rows = df.collect()
    texts = sorted({r.text or "" for r in rows})
    place = dict(zip(texts, plain_classes(texts)[0]))
    columns = [c for c in df.columns if c != "text"]
    got = {}
    for r in nearcopies.near_copy_classes(df, key).collect():
        got[r.t1, r.t2] = r["class"]
    digests = df.select("text", *nearcopies._digests(df["text"])).distinct().collect()
    names = {r.text or "": got[r.t1, r.t2] for r in digests}
    assert same_classes([names[t] for t in texts], [place[t] for t in texts])
    kept = nearcopies.drop_near_copies(df, key)
    assert kept.columns == df.columns
    left = kept.collect()
    assert sorted(place[r.text or ""] for r in left) == sorted(set(place.values()))
    for r in left:
        ids = [x[key] for x in rows if place[x.text or ""] == place[r.text or ""] and x[key] is not None]
        assert r[key] == (min(ids) if ids else None) and r in rows
    return columns


def test_odd_texts(spark):
    check(spark, messy(spark))
    assert nearcopies.drop_near_copies(empty(spark)).collect() == []


def test_edited_copies_and_shared_passages(spark, monkeypatch):
    """A large group of edited copies, a passage in many texts, and texts of little but that passage."""
    monkeypatch.setattr(nearcopies, "MOST", 1)
    rng = random.Random(12)
    base, passage = [f"w{k}" for k in range(120)], [f"p{k}" for k in range(40)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for k in range(60):
        own = [f"t{k}x{i}" for i in range(rng.choice([1, 4, 8, 60]))]
        texts.append(" ".join([*own, *passage]))
    texts += [sentence(rng, rng.randrange(1, 40)) for _ in range(60)] + ["", " ", None, "A b", "a  B"]
    rows = [(rng.choice([None, i]), t, "x", i % 3) for i, t in enumerate(texts)] + [(5, texts[0], "x", 0)] * 3
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, fp string, label long").repartition(5))


def test_recall_and_precision_of_the_pipeline_stage(spark):
    """Every pair of likeness 0.8 of the larger tables, by an index of whole sets instead of heads."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    texts = sorted({r.text or "" for r in df.collect()})
    labels, pairs = plain_classes(texts)
    kept = {r.text or "" for r in corpus_pipeline.remove_near_copies(spark, df, folder).collect()}
    place = dict(zip(texts, labels))
    assert pairs >= 3 and sorted(place[t] for t in kept) == sorted(set(labels))


def test_a_shared_passage_after_own_words_pairs_nothing(spark, monkeypatch):
    """Forty texts of likeness 0.74: all hold one passage, which is late in the order of each."""
    monkeypatch.setattr(nearcopies, "ROUNDS", 8)
    compared, keep = [], nearcopies.Workspace.keep

    def watched(self, df, label):
        out = keep(self, df, label)
        if label == "apart":
            compared.append(out.count())
        return out

    monkeypatch.setattr(nearcopies.Workspace, "keep", watched)
    passage = " ".join(f"p{i}" for i in range(88))
    rows = [(k, " ".join(f"t{k}x{i}" for i in range(11)) + " " + passage) for k in range(40)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert compared == [0, 0]


def test_only_the_decision_stays_on_disk(spark, monkeypatch):
    spaces, made = [], nearcopies.Workspace.__init__

    def watched(self, *arguments):
        made(self, *arguments)
        spaces.append(self)

    monkeypatch.setattr(nearcopies.Workspace, "__init__", watched)
    df = messy(spark)
    kept = nearcopies.drop_near_copies(df)
    left = sorted(p.name for s in spaces for p in Path(s.root.removeprefix("file:")).glob("*"))
    assert len(left) == 1 and left[0].endswith("-kept") and kept.count() > 0
