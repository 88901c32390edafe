"""Fingerprints, edits and likenesses against a plain version."""

import hashlib

import numpy as np
import pytest

from inversia.llm import spotsigs
from tests.llm.messy import documents, empty, messy


def plain(df):
    from pyspark.sql import functions as F

    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    out = []
    for i, r in enumerate(rows):
        following = rows[(i + 1) % len(rows)].text
        n = len(r.text) // 3
        changed = r.text[: len(r.text) - n] + following[:n]
        a, b, c = (set(spotsigs.signatures(t).tolist()) for t in (r.text, changed, following))
        share = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((r.doc_id, len(r.text), hashlib.sha256(changed.encode()).hexdigest(), round(share(a, b), 12), round(share(a, c), 12)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [messy, documents])
def test_table(spark, make):
    df = make(spark)
    got = spotsigs.fingerprint_documents(df).collect()
    found = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got]
    assert sorted(found, key=repr) == plain(df)
    by_text = {}
    texts = {}
    for r in df.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    for r in got:
        if len(texts[r.doc_id]) == 1:
            by_text.setdefault(next(iter(texts[r.doc_id])), set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_one_row_and_none(spark):
    df = documents(spark).limit(1)
    assert spotsigs.fingerprint_documents(df).first().near_next == 1.0
    assert spotsigs.fingerprint_documents(empty(spark)).collect() == []


def test_signatures():
    assert len(spotsigs.signatures("")) == len(spotsigs.signatures(" ... ")) == 0
    assert len(spotsigs.signatures("one")) == 1
    a = spotsigs.signatures("the silver river and the green stone of the old tower")
    b = spotsigs.signatures("THE silver river, and the green stone of the old tower!")
    assert (a == b).all() and len(a) >= 3
    assert (spotsigs.signatures("cat dog") != spotsigs.signatures("dog cat")).all()


def test_likeness_is_pruned_only_below_the_bound():
    a, b = np.arange(10, dtype=np.uint64), np.arange(5, dtype=np.uint64)
    assert spotsigs.likeness(a, b) == 0.5 and spotsigs.likeness(a, b, 0.5) == 0.5 and spotsigs.likeness(a, b, 0.6) == 0.0
    empty_ = np.empty(0, np.uint64)
    assert spotsigs.likeness(empty_, empty_) == 1.0 and spotsigs.likeness(a, empty_) == 0.0


@pytest.mark.parametrize("make", [messy, documents, empty])
@pytest.mark.parametrize("threshold", [0.8, 0.4])
def test_near_copies(spark, make, threshold):
    df = make(spark)
    rows = df.select("doc_id", "text").collect()
    sets = {r.text: frozenset(spotsigs.signatures(r.text or "").tolist()) for r in rows}
    nodes = sorted(set(sets.values()), key=sorted)
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if a and b and len(a & b) >= threshold * len(a | b):
                label[root(a)] = root(b)
    least = {}
    for r in rows:
        if r.doc_id is not None:
            c = root(sets[r.text])
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, least.get(root(sets[r.text]))) for r in rows), key=repr)
    got = spotsigs.near_copies(df, threshold=threshold).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == want
