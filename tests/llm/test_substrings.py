"""Suffix sorting, and removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inversia.llm import induced, substrings
from inversia.llm.induced import SuffixSorter
from tests.llm.messy import documents, empty, messy, sentence


def check_order(text: bytes, cap: int, memory: int = 1 << 20):
    positions, shared = [], []
    for p, s in SuffixSorter(np.frombuffer(text, np.uint8), cap, memory).descending():
        positions += p.tolist()
        shared += s.tolist()
    assert sorted(positions) == list(range(len(text)))
    for i in range(1, len(positions)):
        a, b = text[positions[i - 1] :][:cap], text[positions[i] :][:cap]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[i] == n and a >= b


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=60), st.sampled_from([3, 10, 100]), st.sampled_from([1, 1 << 20]))
def test_suffix_order(text, cap, memory):
    check_order(text.encode(), cap, memory)  # one byte of memory: every queue goes to disk


@pytest.mark.parametrize("text", [b"a", b"aaaaaaa", b"abababab", b"ba", b"\xff\xff", b"abc\xffabc\xffabcab\xff"])
def test_suffix_order_edges(text):
    check_order(text, 100)


def plain(rows):
    """Removed bytes of documents [(order, data)], each string judged in document order."""
    seen, out = set(), {}
    for order, data in sorted(rows):
        mask, end = np.zeros(len(data), bool), 0
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                mask[max(p, end) : p + 100] = True
                end = p + 100
            seen.add(w)
        out[order] = mask
    return out


def check(df, **options):
    docs = [(r.id, r.key, r.tie, r.text.encode()) for r in substrings.keyed(df, "doc_id", "text").collect()]
    masks = plain({((k, t), d) for _, k, t, d in docs})
    want = []
    for own, k, t, data in docs:
        mask = masks[k, t]
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
        want.append((own, len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = sorted(map(tuple, substrings.digest_cut(df, **options).collect()), key=repr)
    assert got == sorted(want, key=repr)
    return got


def test_messy_rows(spark):
    check(messy(spark))


def test_whole_table(spark):
    got = check(documents(spark))
    assert sum(r[2] for r in got) > 0 and check(documents(spark), most=2) == got


@pytest.mark.parametrize("most", [2, substrings.MOST_CLASSES])
def test_stretches_joined_to_their_texts(spark, monkeypatch, most):
    """Beyond what the filter is for, the same stretches are sent, to the same result."""
    with_filter = check(documents(spark), most=most)
    monkeypatch.setattr(substrings, "MOST_FILTERED", 0)
    assert check(documents(spark), most=most) == with_filter


def test_no_more_text_is_sent_when_joined(spark):
    from inversia.llm.workspace import Workspace

    space = Workspace(spark, "test")
    source = substrings.keyed(documents(spark), "doc_id", "text").select("key", "tie", "text")
    _, unsure = substrings._judged(source.mapInArrow(substrings._stretch_rows, substrings.SCHEMA), space)
    classes = unsure.groupBy("anchor").count().withColumnRenamed("count", "n")
    opened = substrings._with_open(source, unsure, classes, 10**9)

    def lengths(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in substrings._sent_pieces(substrings._opened(batch, False)):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in piece.column(4).to_pylist()], pa.int64())], ["n"])

    joined = opened.mapInArrow(lengths, "n long").agg({"n": "sum"}).first()[0]
    filtered = substrings._texts_of(source, substrings._filter_of(unsure, whole=True), None).selectExpr("length(piece) as n").agg({"n": "sum"}).first()[0]
    assert 0 < joined <= filtered


def test_a_shard_above_the_queues_memory_goes_to_disk():
    rng = random.Random(13)
    text = "\xff".join(sentence(rng, 60) for _ in range(40)).encode("latin-1")
    check_order(text * 2, 100, memory=1 << 12)


def test_types_are_told_across_blocks(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(induced, "BATCH", 4)
    for _ in range(200):
        check_order(bytes(rng.choice(b"aab") for _ in range(rng.randrange(1, 40))), 100)


def test_crafted_overlaps(spark):
    rng = random.Random(2)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    texts = [a, b + a[:150] + c, a[20:250] + b[:99], a[:100], a[:99], "x" * 400, "x" * 150, "ab" * 120, c + c, b[30:] + a[100:210] + b[:200], "é" * 90, "é" * 120]
    texts += [rng.choice([a, b, c])[i : i + rng.randrange(90, 300)] for i in range(0, 200, 5)]
    df = spark.createDataFrame([(i * 7 % 101, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert check(df) == check(df, most=1) == check(df, most=3)


def test_many_contexts_of_one_passage(spark):
    """One anchor with a class per document: taken apart into strings, with the same result."""
    rng = random.Random(11)
    passage = sentence(rng, 60)
    df = spark.createDataFrame([(i, f"{rng.random()} {passage} {rng.random()}" * (1 + i % 2)) for i in range(60)], "doc_id long, text string").repartition(5)
    assert check(df) == check(df, most=10)


def test_blocks_of_a_long_text_agree(monkeypatch):
    data = np.frombuffer(sentence(random.Random(9), 600).encode(), np.uint8)

    def strings():
        out = {}
        for h, at, first, last in substrings.stretches(data.tobytes()):
            for x, a, i, j in zip(h.tolist(), at.tolist(), first.tolist(), last.tolist()):
                out |= {p: (x, a) for p in range(i, j + 1)}
        return out

    whole = strings()
    assert sorted(whole) == list(range(len(data) - 99))
    assert all(p <= a <= p + 68 for p, (_, a) in whole.items())
    monkeypatch.setattr(substrings, "BLOCK", 256)
    # positions tie-broken by place, hashes compared without their lowest bits: equal texts, equal anchors
    assert sorted(strings()) == sorted(whole)


def test_equal_strings_have_equal_anchors():
    rng = random.Random(4)
    text = sentence(rng, 80).encode()
    x, y = b"first " + text + b" end", b"quite another beginning " + text
    found = []
    for data, begin in ((x, 6), (y, 24)):
        own = {}
        for h, at, first, last in substrings.stretches(data):
            for k, a, i, j in zip(h.tolist(), at.tolist(), first.tolist(), last.tolist()):
                own |= {p - begin: (k, a - begin) for p in range(i, j + 1)}
        found.append({p: v for p, v in own.items() if 0 <= p <= len(text) - 100})
    assert found[0] == found[1]


def test_empty_table(spark):
    assert substrings.digest_cut(empty(spark)).collect() == []


def test_covered():
    assert substrings.covered(np.array([5, 0, 300]), np.array([9, 3, 300])) == [(0, 109), (300, 400)]
