"""Near-duplicate groups by SimHash fingerprints and BK-trees.

A fingerprint has a bit where over half of the text's shingle hashes have it. Two fingerprints
link if at most RADIUS bits differ. Equal fingerprints are one node, so copies cost nothing here.

Trees of shards: the 64 bits are cut into BLOCKS blocks; of two linked fingerprints at least
BLOCKS - RADIUS blocks agree, so they meet in the shard of those blocks' values. Every fingerprint
goes to one shard for each choice of so many blocks. A shard's BK-tree is built where its
fingerprints are sent, and each of them searches it along the edges within the radius. (A tree that
grows with the data is not sent to every task: it reaches the tasks that search it by the shuffle.)

A shard of more than MOST fingerprints is cut into chunks by hash, and every pair of its chunks is a
tree of its own, so no task holds a large shard whole and no link is lost. A task sends one link per
fingerprint at most: to the smallest one its shard connects it with."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.llm.bktree import Forest, join_labels
from inversia.llm.components import connected_components
from inversia.llm.workspace import Workspace, bytes_of, per_batch

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCKS, MOST = 6, 4096
#: Shingles hashed at once, and rows of whole shards searched at once.
HASHED, SEARCHED = 1 << 15, 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text in UTF-8; 0 if it has no words (or is null).

    ASCII letters are lowered; words are runs of anything but space and U+0009 to U+000D; a shingle
    is ``shingle`` words with single spaces between, and a shorter text is one shingle."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for i in range(0, n, HASHED):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + HASHED], last[i : i + HASHED])], np.uint64)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) of every row."""
    narrow = df.select(df[key].alias("key"), df[text].alias("text"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, shingle) for t in bytes_of(batch.column(1))], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

        return work

    return per_batch(narrow, make, f"key {narrow.schema['key'].dataType.simpleString()}, fp long")


def _masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks - radius blocks, the bits of those blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(own, max(1, blocks - radius))]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def near_links(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """``a``, ``b``: links that connect exactly what pairs of ``fp`` at most ``radius`` apart connect.

    ``fingerprints``: one row per different ``fp``. ``blocks`` must be above ``radius``."""
    if blocks <= radius:
        raise ValueError("fewer blocks than bits that may differ, and one more, lose links")
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(_masks(radius, blocks))])
    spread = fingerprints.select("fp", F.explode(masks).alias("mask"))
    spread = spread.select("fp", F.xxhash64("mask.i", F.col("fp").bitwiseAND(F.col("mask.m"))).alias("shard"))
    large = spread.groupBy("shard").count().where(F.col("count") > most).select("shard", F.ceil(F.col("count") / most).cast("int").alias("chunks"))
    cut = spread.join(large, "shard", "left").withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
    others = F.expr("CASE WHEN chunks IS NULL THEN array(-1) ELSE filter(sequence(0, chunks - 1), c -> c <> chunk) END")
    pairs = cut.select("fp", "shard", "chunk", F.explode(others).alias("other"))
    tree = F.when(F.col("other") < 0, F.col("shard")).otherwise(F.xxhash64("shard", F.least("chunk", "other"), F.greatest("chunk", "other")))
    trees = pairs.select(tree.alias("tree"), "fp").repartition("tree").sortWithinPartitions("tree", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            tree = np.concatenate([tree, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if len(tree) >= SEARCHED and tree[0] != tree[-1]:
                whole = int(np.searchsorted(tree, tree[-1]))  # the last tree may go on
                yield _connected(tree[:whole], fp[:whole], radius)
                tree, fp = tree[whole:], fp[whole:]
        if len(tree):
            yield _connected(tree, fp, radius)

    return trees.mapInArrow(search, "a long, b long")


def _connected(tree: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    counts = np.unique(tree, return_inverse=True, return_counts=True)
    several = counts[2][counts[1]] > 1
    tree, fp = tree[several], fp[several]
    different = np.ones(len(fp), bool)  # trees whose hashes meet by chance may hold a value twice
    different[1:] = (tree[1:] != tree[:-1]) | (fp[1:] != fp[:-1])
    tree, fp = tree[different], fp[different]
    labels = np.arange(len(fp))
    if len(fp):
        for a, b in Forest(fp.view(np.uint64), tree).within(radius):
            join_labels(labels, a, b)
    linked = np.flatnonzero(labels != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[labels[linked]])], ["a", "b"])


def component_of_fingerprints(fingerprints: DataFrame, space: Workspace, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fp``, ``component`` (the smallest key of its component) from rows of ``key``, ``fp``.

    A component of null keys only has a null one."""
    nodes = space.keep(fingerprints.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    labels = space.keep(connected_components(near_links(nodes.select("fp"), radius, blocks), space), "labels")
    linked = nodes.join(labels, nodes["fp"] == labels["node"]).select("fp", "label", "least")
    smallest = linked.groupBy("label").agg(F.min("least").alias("component"))
    known = linked.join(smallest, "label").select("fp", "component")
    alone = nodes.join(labels, nodes["fp"] == labels["node"], "left_anti").select("fp", F.col("least").alias("component"))
    return known.unionByName(alone)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits), ``component_id`` of every row.

    ``component_id`` is the smallest key reachable over links, the row's own included. Null keys are
    kept and never the smallest; a component of null keys only has a null id. Repeated rows stay."""
    space = Workspace(df.sparkSession, "simhash")
    found = space.keep(with_fingerprints(df, key, text, shingle), "fingerprints")
    components = component_of_fingerprints(found, space, radius)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(components, "fp").select(F.col("key").alias(key), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group stays, with all columns: the one of the smallest key (nulls last), then
    of the smallest hash of the row; of equal rows one."""
    space = Workspace(df.sparkSession, "simhash")
    sent = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[key].alias("key"), df[text].alias("text"))

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in bytes_of(texts)], np.uint64).view(np.int64))

    found = space.keep(sent.select("row", "key", fp("text").alias("fp")), "fingerprints")
    components = component_of_fingerprints(found.select("key", "fp"), space, radius)
    # first one row per fingerprint, so that copies meet in sums before any join
    order = F.struct(F.col("key").isNull(), F.col("key"), F.xxhash64("row"))
    best = found.groupBy("fp").agg(F.min_by(F.struct("row", "key"), order).alias("best"))
    # components without a key of their own are named by their fingerprints alone
    group = F.struct(F.col("component"), F.when(F.col("component").isNull(), F.col("fp")).alias("fp"))
    joined = best.join(components, "fp").select("best", group.alias("group"))
    order = F.struct(F.col("best.key").isNull(), F.col("best.key"), F.xxhash64("best.row"))
    kept = joined.groupBy("group").agg(F.min_by(F.col("best.row"), order).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
