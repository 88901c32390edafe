"""Fingerprints and components against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from inversia.llm import bktree, simhash
from inversia.llm.components import connected_components
from inversia.llm.workspace import Workspace
from tests.llm.messy import documents, empty, messy


def plain_fingerprint(text, shingle=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, radius=4):
    """rows: (key, fingerprint); components by a search over all pairs."""
    prints = sorted({f for _, f in rows})
    links = defaultdict(set)
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                links[a].add(b)
                links[b].add(a)
    least = {}
    for f in prints:
        keys = [k for k, g in rows if g == f and k is not None]
        least[f] = min(keys) if keys else None
    out, seen = {}, set()
    for f in prints:
        if f in seen:
            continue
        group, stack = [], [f]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                group.append(x)
                stack += links[x]
        keys = [least[x] for x in group if least[x] is not None]
        out |= {x: min(keys) if keys else None for x in group}
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b C", "A b C d", "The cat\tsat\x0bon the mat. É É ß", "x " * 300, "  \u0085 a"])
@pytest.mark.parametrize("shingle", [4, 5])
def test_fingerprint(text, shingle):
    data = None if text is None else text.encode()
    assert simhash.fingerprint(data, shingle) == plain_fingerprint(text, shingle)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 13}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "HASHED", 64)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def check(df):
    rows = df.select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows])
    got = simhash.near_duplicates(df).collect()
    expected = sorted(((r.doc_id, f"{plain_fingerprint(r.text):016x}", want[plain_fingerprint(r.text)]) for r in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == expected


def test_messy_rows(spark):
    check(messy(spark))


def test_whole_table(spark):
    check(documents(spark))


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.drop_near_duplicates(empty(spark)).columns == empty(spark).columns


def near_prints(n, seed=1):
    rng = np.random.default_rng(seed)
    out = {int(x) for x in rng.integers(0, 2**63, n // 2)}
    center = 0x123456789ABCDEF0
    while len(out) < n:
        x = center
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 50])
def test_links_connect_what_pairs_do(spark, most):
    prints = near_prints(600)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(table, most=most)
    labels = {r.node: r.label for r in connected_components(links, Workspace(spark, "test")).collect()}
    want = plain_components([(s, p) for s, p in zip(signed, prints)])
    groups = defaultdict(set)
    for s, p in zip(signed, prints):
        groups[labels.get(s, s)].add(p)
    expected = defaultdict(set)
    for p, c in want.items():
        expected[c].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_bk_search_finds_all_pairs(monkeypatch):
    monkeypatch.setattr(bktree, "FRONTIER", 500)
    values = np.array(near_prints(300, 4), np.uint64)
    shard = np.sort(np.random.default_rng(0).integers(0, 4, len(values)))
    found = {(int(a), int(b)) for x, y in bktree.Forest(values, shard).within(4) for a, b in zip(x, y)}
    want = {
        (i, j) for i in range(300) for j in range(i + 1, 300) if shard[i] == shard[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 4
    }
    assert found == want


def test_too_few_blocks_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "fp long"), radius=4, blocks=4)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)] + [(201, 200), (200, 201)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_one_row_of_each_group_stays(spark):
    df = messy(spark)
    kept = simhash.drop_near_duplicates(df).collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()])
    groups = {(c, f if c is None else None) for f, c in want.items()}
    assert kept[0].__fields__ == df.columns and len(kept) == len(groups)
    assert {r.doc_id for r in kept if r.doc_id is not None} == {c for c, _ in groups if c is not None}
    originals = {tuple(r) for r in df.collect()}
    assert all(tuple(r) in originals for r in kept)
