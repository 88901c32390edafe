"""Groups of texts whose sets of five-word shingles are alike: SimHash first, then a search that misses none.

Two texts link if the Jaccard likeness of their sets is THRESHOLD or more; every link is confirmed on
the sets themselves. Candidates come from two searches:

* **SimHash.** Fingerprints linked by BK-trees (see ``simhash``) find copies and light edits cheaply.
* **Heads.** Of two sets that are alike enough, the first ``n - ceil(THRESHOLD n) + 1`` shingles of
  each, in any order that holds for all sets, have one in common. The order is by hash; shingles that
  lead more than MOST heads (a passage that some texts share) are moved to its end and the heads they
  were in are drawn again, so that such a shingle counts only for texts that hold little else. Any
  order is right: which shingles are moved decides how many candidates there are, not what is found.

Texts that share a head shingle are first paired with the smallest and the largest of them. Of two
texts the one whose head ends first in the order has no shared shingle in it that the other's head
lacks; so the number of shared head shingles says how many the texts can share at most, and pairs
that fall short are dropped unread. What the others connect needs no further comparison, so of a
large group of near copies only what stands apart is compared with the rest: under the first shingle
that two alike texts share, enough of both must still follow in the order for all that they share. So
a passage that many texts hold after words of their own pairs none of them. Equal texts are one node,
by a digest of 128 bits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inversia.llm.components import connected_components
from inversia.llm.simhash import near_links
from inversia.llm.workspace import Workspace, bytes_of, per_batch

SHINGLE, THRESHOLD, SEED = 5, 0.8, 42
#: A shingle that leads more heads is moved to the end of the order, in so many rounds, so many in a
#: round at most (the most common ones; they are sent to every task).
MOST, ROUNDS, MOVED = 3, 2, 1 << 20
#: Tables of ids are sent to every task up to so many bytes, arrays of hashes up to so many of them;
#: larger ones are shuffled.
MOST_SENT, MOST_HASHES = 8 << 20, 4 << 20
#: So many shingles before one say whether two texts have met already.
BEFORE = 16
#: The head of a text without words.
WORDLESS = 0
HASHED = 1 << 15


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle of a text, repeats included; ASCII letters lowered, words between
    spaces and U+0009 to U+000D, fewer words than a shingle being one."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.int64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    parts = [np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + HASHED], last[i : i + HASHED])], np.uint64) for i in range(0, n, HASHED)]
    return np.concatenate(parts).view(np.int64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of a text's shingles, as a signed long; 0 without any."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHED):
        bits += np.unpackbits(hashes[i : i + HASHED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def head_length(n: int, threshold: float) -> int:
    return n - int(np.ceil(n * threshold - 1e-9)) + 1


def _digests(text: Column) -> list[Column]:
    plain = F.coalesce(text, F.lit(""))
    return [F.xxhash64(plain).alias("t1"), F.xxhash64(F.lit(1), plain).alias("t2")]


def scanned(df: DataFrame, key: str, text: str, threshold: float, shingle: int) -> DataFrame:
    """``key``, ``row`` (a hash of the whole row), ``t1``, ``t2``, ``fp``, ``n`` (different shingles),
    ``front`` (the smallest of them, twice as many as a head) of every row; one pass over the texts."""
    narrow = df.select(df[key].alias("key"), _row(df), *_digests(df[text]), df[text].alias("text"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps, sizes, fronts = [], [], []
            for body in bytes_of(batch.column(4)):
                hashes = shingle_hashes(body, shingle)
                own = np.unique(hashes)
                fps.append(fingerprint_of(hashes))
                sizes.append(len(own))
                fronts.append(own[: 2 * head_length(len(own), threshold)] if len(own) else np.array([WORDLESS], np.int64))
            columns = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fronts, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["key", "row", "t1", "t2", "fp", "n", "front"])

        return work

    return per_batch(narrow, make, f"key {narrow.schema['key'].dataType.simpleString()}, row long, t1 long, t2 long, fp long, n long, front array<long>")


def sent(table: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for broadcast if its size, now checked, allows it."""
    return F.broadcast(table) if table.count() * row_bytes <= MOST_SENT else table


def _row(df: DataFrame) -> Column:
    return F.xxhash64(*[df[c] for c in df.columns]).alias("row")


def _sets(df: DataFrame, text: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """``t1``, ``t2``, ``found`` (the different shingle hashes, ascending) of the texts wanted (``t1, t2,
    row``: one row that has the text). Rows that are equal in all columns give their text again."""
    texts = df.select(*_digests(df[text]), _row(df), df[text].alias("text")).join(sent(wanted, 64), ["t1", "t2", "row"], "left_semi")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.unique(shingle_hashes(body, shingle)) for body in bytes_of(batch.column(2))]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["t1", "t2", "found"])

        return work

    return per_batch(texts.select("t1", "t2", "text"), make, "t1 long, t2 long, found array<long>")


def _is_late(hashes: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Which of the hashes are in the sorted array ``late``."""
    if not len(late):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
    return late[at] == hashes


def _drawn(table: DataFrame, late: np.ndarray, threshold: float, whole: bool, kept: np.ndarray | None = None) -> DataFrame:
    """``t1``, ``t2``, ``n``, ``head`` and ``place`` (its hashes' places in the set's order, from 0) from
    the ascending hashes of each row (``t1, t2, n, hashes``); of the head only hashes that are in
    ``kept``, if that is given.

    Unless the hashes are the ``whole`` set, a head that they don't suffice for is null."""
    held = table.sparkSession.sparkContext.broadcast((late, kept))  # of bounded lengths

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        late, kept = held.value

        def head(n: int, own: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
            length = head_length(n, threshold) if n else 1
            moved = _is_late(own, late)
            first = own[~moved][:length]
            if len(first) < length:
                if not whole and len(own) < n:
                    return None, None
                first = np.concatenate([first, own[moved]])[:length]
            place = np.arange(len(first)) if kept is None else np.flatnonzero(_is_late(first, kept))
            return first[place], place

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [head(n, hashes.values.to_numpy()) for n, hashes in zip(batch.column(2).to_pylist(), batch.column(3))]
            columns = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["t1", "t2", "n", "head", "place"])

        return work

    return per_batch(table, make, "t1 long, t2 long, n long, head array<long>, place array<long>")


def _heads(df: DataFrame, text: str, nodes: DataFrame, space: Workspace, threshold: float, shingle: int) -> DataFrame:
    """``h``, ``place`` (in the text's order), ``t1``, ``t2``, ``n`` of the head shingles that several texts share."""
    late = np.empty(0, np.int64)
    fronts = nodes.select("t1", "t2", "n", "front")
    for turn in range(ROUNDS + 1):
        drawn, again = _drawn(fronts, late, threshold, False), None
        if len(late):
            # few texts hold so many moved shingles that their front is used up; they are read again
            short = space.keep(drawn.where("head IS NULL").select("t1", "t2").join(nodes.select("t1", "t2", "row"), ["t1", "t2"]), "short")
            again = space.keep(_sets(df, text, short, shingle).select("t1", "t2", F.size("found").cast("long").alias("n"), "found"), "again")
            drawn = drawn.where("head IS NOT NULL").unionByName(_drawn(again, late, threshold, True))
        shared = drawn.select(F.explode("head").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
        shared = space.keep(shared, "shared")
        if turn == ROUNDS:
            break
        crowded = shared.where((F.col("c") > MOST) & (F.col("h") != WORDLESS)).orderBy(F.desc("c"), "h").limit(MOVED).select("h")
        fresh = np.setdiff1d(crowded.toArrow()["h"].to_numpy(), late)
        if not len(fresh):
            break
        late = np.union1d(late, fresh)
    if shared.count() <= MOST_HASHES:
        kept = np.sort(shared.select("h").toArrow()["h"].to_numpy())
        drawn = _drawn(fronts, late, threshold, False, kept)
        if again is not None:
            drawn = drawn.where("head IS NOT NULL").unionByName(_drawn(again, late, threshold, True, kept))
        return _one_by_one(drawn)
    return _one_by_one(drawn).join(shared.select("h"), "h", "left_semi")


def _one_by_one(drawn: DataFrame) -> DataFrame:
    return drawn.select(F.inline(F.arrays_zip(F.col("head").alias("h"), F.col("place").alias("place"))), "t1", "t2", "n")


PAIR, SIZES = ["a1", "a2", "b1", "b2"], ["an", "bn"]


def _ordered(a: Column, b: Column, threshold: float) -> Column:
    """One pair, the smaller text first, or null if their sizes are too far apart for a link."""
    first, last = F.least(a, b), F.greatest(a, b)
    ends = zip(("a1", "a2", "an", "b1", "b2", "bn"), (first, first, first, last, last, last), ("t1", "t2", "n", "t1", "t2", "n"))
    near = first["n"] >= last["n"] * threshold - 1e-9
    return F.when(near & ((first["t1"] != last["t1"]) | (first["t2"] != last["t2"])), F.struct(*[x[f].alias(n) for n, x, f in ends]))


def _needed(an: Column, bn: Column, threshold: float) -> Column:
    """How many shingles two texts of these numbers must share."""
    return F.ceil((an + bn) * (threshold / (1 + threshold)) - 1e-9)


def _possible(pairs: DataFrame, hidden: DataFrame, threshold: float) -> DataFrame:
    """The pairs (with ``s``, shared head shingles that were seen) that may be alike. ``hidden``: for a
    text, how many of its head shingles more it may share unseen."""
    for side in ("a", "b"):
        own = hidden.select(F.col("t1").alias(f"{side}1"), F.col("t2").alias(f"{side}2"), F.col("hidden").alias(f"{side}h"))
        pairs = pairs.join(own, [f"{side}1", f"{side}2"], "left")
    shared = F.col("s") + F.least(F.coalesce("ah", F.lit(0)), F.coalesce("bh", F.lit(0)))
    needed = _needed(F.col("an"), F.col("bn"), threshold)

    def fits(n: Column) -> Column:
        head = F.when(n > 0, n - F.ceil(n * threshold - 1e-9) + 1).otherwise(1)
        return head - shared <= n - needed

    return pairs.where(fits(F.col("an")) | fits(F.col("bn"))).select(*PAIR)


def _confirmed(df: DataFrame, text: str, nodes: DataFrame, pairs: DataFrame, space: Workspace, threshold: float, shingle: int) -> DataFrame:
    """The pairs that are alike, as links of nodes named by text."""
    ends = pairs.select(F.col("a1").alias("t1"), F.col("a2").alias("t2")).unionByName(pairs.select(F.col("b1").alias("t1"), F.col("b2").alias("t2"))).distinct()
    ends = space.keep(ends.join(nodes.select("t1", "t2", "row"), ["t1", "t2"]), "ends")
    sets = space.keep(_sets(df, text, ends, shingle), "sets")
    both = pairs.join(sets.toDF("a1", "a2", "x"), ["a1", "a2"]).join(sets.toDF("b1", "b2", "y"), ["b1", "b2"])
    # row by row: sets of long texts would fill an Arrow batch
    shared = F.size(F.array_intersect("x", "y"))
    near = both.where(shared >= threshold * (F.size("x") + F.size("y") - shared) - 1e-9)
    links = space.keep(near.select(_name("a1", "a2").alias("a"), _name("b1", "b2").alias("b")), "links")
    space.drop(ends, sets)
    return links


def _name(t1: str, t2: str) -> Column:
    return F.concat(F.lpad(F.hex(t1), 16, "0"), F.lpad(F.hex(t2), 16, "0"))


def _classes(df: DataFrame, text: str, nodes: DataFrame, space: Workspace, threshold: float, shingle: int) -> DataFrame:
    """``node`` (name), ``label`` of every text that has a link."""
    # SimHash: equal fingerprints, and those that the trees link
    by_fp = space.keep(nodes.groupBy("fp").agg(F.min(F.struct("n", "t1", "t2")).alias("rep"), F.count("*").alias("c")), "fingerprints")
    node = F.struct("n", "t1", "t2")
    equal = nodes.select("fp", node.alias("node")).join(by_fp.where("c > 1"), "fp").select(_ordered(F.col("node"), F.col("rep"), threshold).alias("pair"))
    reps = by_fp.select("fp", "rep")
    linked = near_links(by_fp.select("fp"), most=4096)
    linked = linked.join(reps.toDF("a", "x"), "a").join(reps.toDF("b", "y"), "b").select(_ordered(F.col("x"), F.col("y"), threshold).alias("pair"))
    # heads: each text with the smallest and the largest of those it shares a shingle with
    members = space.keep(_heads(df, text, nodes, space, threshold, shingle).select("h", "place", node.alias("node")), "members")
    ends = space.keep(members.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("c")), "ends")
    two = ends.where("c = 2").select(_ordered(F.col("lo"), F.col("hi"), threshold).alias("pair"))
    members = space.keep(members.join(sent(ends.where("c > 2"), 96), "h"), "members")
    low = members.where("node <> lo").select(_ordered(F.col("node"), F.col("lo"), threshold).alias("pair"))
    high = members.where("node <> lo AND node <> hi").select(_ordered(F.col("node"), F.col("hi"), threshold).alias("pair"))
    seen = two.unionByName(low).unionByName(high).where("pair IS NOT NULL").select("pair.*")
    seen = space.keep(seen.groupBy(*PAIR, *SIZES).agg(F.count("*").alias("s")), "seen")
    # of four and more texts under one shingle not all pairs are seen there
    members = members.where("c > 3")
    hidden = space.keep(members.groupBy("node.t1", "node.t2").agg(F.count("*").alias("hidden")).toDF("t1", "t2", "hidden"), "hidden")
    by_print = equal.unionByName(linked).where("pair IS NOT NULL").select("pair.*").select(*PAIR)
    pairs = space.keep(_possible(seen, hidden, threshold).unionByName(by_print).distinct(), "pairs")
    links = _confirmed(df, text, nodes, pairs, space, threshold, shingle)
    labels = space.keep(connected_components(links, space), "labels")
    # what is still apart: pairs of different classes under one shingle
    named = members.select("h", "place", "node", _name("node.t1", "node.t2").alias("name"))
    placed = space.keep(named.join(labels, named["name"] == labels["node"], "left").select("h", "place", named["node"], F.coalesce("label", "name").alias("label")), "placed")
    open_ = placed.groupBy("h").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("h")
    left = placed.join(space.keep(open_, "open"), "h", "left_semi")
    # they meet under the first shingle they share: what follows it in either must suffice for all they
    # share, and the few shingles just before it have none in common
    own = left.groupBy("node", "label").agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("own"))
    own = own.select("node", "label", "own", F.posexplode("own").alias("i", "e"))
    before = F.transform(F.slice("own", F.greatest(F.col("i") - BEFORE, F.lit(0)) + 1, F.least(F.col("i"), F.lit(BEFORE))), lambda e: e["h"])
    left = space.keep(own.select("e.h", "node", "label", (F.col("node.n") - F.col("e.place")).alias("rest"), before.alias("before")), "left")
    a = left.where(F.col("rest") >= _needed(F.col("node.n"), F.col("node.n"), threshold)).toDF("h", "x", "label_x", "rest_x", "before_x")
    b = left.toDF("h", "y", "label_y", "rest_y", "before_y")
    near = (F.col("x.n") >= F.col("y.n") * threshold - 1e-9) & (F.least("rest_x", "rest_y") >= _needed(F.col("x.n"), F.col("y.n"), threshold))
    met = a.join(b, "h").where((F.col("label_x") != F.col("label_y")) & (F.col("x") < F.col("y")) & near & ~F.arrays_overlap("before_x", "before_y"))
    apart = met.select(_ordered(F.col("x"), F.col("y"), threshold).alias("pair"))
    apart = apart.where("pair IS NOT NULL").select("pair.*").select(*PAIR).distinct()
    apart = space.keep(apart.join(seen.select(*PAIR), PAIR, "left_anti").join(pairs, PAIR, "left_anti"), "apart")
    further = _confirmed(df, text, nodes, apart, space, threshold, shingle)
    return space.keep(connected_components(links.unionByName(further), space), "classes")


def near_copy_classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``key``, ``row``, ``t1``, ``t2`` and ``class`` (a name shared by all texts that links reach) of every row.

    Null texts are empty texts; texts without words are one class; repeated rows are in one class."""
    return _placed(df, key, text, threshold, shingle, Workspace(df.sparkSession, "nearcopies"))


def _placed(df: DataFrame, key: str, text: str, threshold: float, shingle: int, space: Workspace) -> DataFrame:
    rows = space.keep(scanned(df, key, text, threshold, shingle), "scanned")
    nodes = space.keep(rows.groupBy("t1", "t2").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("fp", "n", "front")]), "nodes")
    classes = _classes(df, text, nodes, space, threshold, shingle)
    space.clear(rows, classes)
    named = rows.select("key", "row", "t1", "t2", _name("t1", "t2").alias("name"))
    # a text of very many copies is an equi-join side that Spark splits
    return named.join(classes, named["name"] == classes["node"], "left").select("key", "row", "t1", "t2", F.coalesce("label", "name").alias("class"))


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row of each class stays, with all columns: the one of the smallest key (nulls last), then
    of the smallest hash of the row; of equal rows one.

    It is decided on keys and hashes alone; whole rows move once, to meet the decisions."""
    space = Workspace(df.sparkSession, "nearcopies")
    placed = space.keep(_placed(df, key, text, threshold, shingle, space), "classes")
    choice = F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "row", "t1", "t2")).alias("best")
    best = placed.groupBy("class").agg(choice).select("best.row", "best.t1", "best.t2", F.col("best.key").alias("k"))
    same = placed.groupBy("row", "t1", "t2").agg(F.count("*").alias("times")).where("times > 1")
    kept = space.keep(best.join(same, ["row", "t1", "t2"], "left").withColumn("repeated", F.col("times").isNotNull()).drop("times", "k"), "kept")
    space.clear(kept)
    whole = F.struct(*[df[c] for c in df.columns]).alias("whole")
    rows = df.select(whole, _row(df), *_digests(df[text]))
    found = rows.join(kept, ["row", "t1", "t2"])
    # rows that occur more than once are few kinds: copies meet where they are read
    single = found.where("NOT repeated").select("whole")
    repeated = found.where("repeated").groupBy("row", "t1", "t2").agg(F.first("whole").alias("whole")).select("whole")
    return single.unionByName(repeated).select(*[F.col("whole").getField(c).alias(c) for c in df.columns])
