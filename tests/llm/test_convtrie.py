"""The prefix trie against one built turn by turn."""

import hashlib
import math
import random
import struct
import zlib

import pytest
import xxhash

from inversia.llm import convtrie
from inversia.llm.queries import ORACLES, QUERIES
from tests.llm.messy import FOLDER
from tests.oracle import connect, difference

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth long, p1 string, n long"


def said_hash(role, text):
    """The order of turns of equal number."""
    out = []
    for seed in (11, 12):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        for part in (role, text):
            h = xxhash.xxh64_intdigest(part.encode(), h)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn, said_hash(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    out, sums = [], {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(path, [])]
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        sums[path] = (saved + sum(s for s, _ in below), sum(n for _, n in below) if below else 1)
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if len(rebuilt[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(children.get(path, [])), sums[path][1], sums[path][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)
    got = convtrie.prefix_trie(df, **options)
    assert got.columns == COLUMNS and all(kind == "bigint" for c, kind in got.dtypes[:-1])
    return sorted(map(tuple, got.collect()), key=repr)


def odd_rows():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 14), *range(100, 108), 205, 311, 312, -7, -100, 10**12]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, None, 0, 5000 + turn, -turn]), rng.choice(["user", None, "bot", ""]), rng.choice(["hi", "hi", "é🙂", None, "", "x" * 300])))
    rows += rows[:5] + [(None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [1, 4])
def test_odd_conversations(spark, block):
    rows = odd_rows()
    assert trie_of(spark, rows, block=block) == plain_trie(rows)


def test_copies_and_shared_starts(spark):
    """Many copies of one conversation, and siblings that part inside blocks, at their ends and by stopping."""
    rng = random.Random(8)
    rows = []
    for c in range(0, 260):
        base = [("user", f"q{k}") for k in range(11)]
        cut = rng.choice([11, 11, 11, 3, 4, 5, 8])
        for turn, (role, text) in enumerate(base[:cut] + [("bot", f"own {rng.randrange(3)}")] * rng.choice([0, 0, 1, 4])):
            rows.append((c, turn, role, text))
    assert trie_of(spark, rows) == plain_trie(rows)


def test_long_conversation_and_id_ranges(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "TURNS", 16)
    monkeypatch.setattr(convtrie, "IDS", 8)
    rows = [(3, turn, "user", f"t{turn % 5}") for turn in range(300)] + [(c, 0, "user", "same") for c in range(400, 470)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_no_conversations(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "a", "b")]) == []


def test_only_turnless_members(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone")]
    assert trie_of(spark, rows) == plain_trie(rows) and len(plain_trie(rows)) == 1


def test_query_against_sql(spark):
    assert difference(QUERIES["op11_prefix_trie"](spark, FOLDER), connect(FOLDER), ORACLES["op11_prefix_trie"]) is None
