"""The trie of conversation prefixes, by digests of blocks of turns.

A conversation is cut into blocks of BLOCK turns. A turn has a digest of 128 bits; the digest of a
prefix combines those of its turns, each hashed with its position, by exclusive or, so that it is a
running sum and prefixes are known without walking them turn by turn.

First, conversations are grouped by their successive block digests: equal prefixes that end in equal
blocks are one block node, however many conversations go through it. Then turns are looked at. Where
a block has no sibling (no other block after the same prefix), its turns are a plain chain. Only
where siblings diverge are turn boundaries compared, one row for each sibling and turn: siblings
share nodes up to where they part.

Sums over subtrees need no walk either. Each node is owned by its smallest member; what a node
contributes is put on its owner's row, summed backwards along the owner's conversation, and the sums
of all members of a node add up to the sum of its subtree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inversia.llm.workspace import Workspace

BLOCK = 4
#: A conversation takes up to GRAFTED - 1 turns of the first one of its GROUP ids.
GROUP, GRAFTED = 100, 6
#: Turns of one conversation are ranked in ranges of so many turn numbers; ids are joined in ranges of so many ids.
TURNS, IDS = 1024, 4096


def _lanes(*parts: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(F.lit(seed), *parts) for seed in (11, 12)]


def ordered_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``rank`` from 0, ``t1``, ``t2`` (digest of role and text), ``chars`` of every turn.

    Ranks are counted per range of turn numbers and shifted by the turns before the range."""
    said = [F.coalesce(df[c], F.lit("")) for c in (role, text)]
    rows = df.where(df[key].isNotNull()).select(
        df[key].cast("long").alias("conv"), df[turn].cast("long").alias("turn"), *[x.alias(n) for x, n in zip(_lanes(*said), ("t1", "t2"))], F.length(said[1]).cast("long").alias("chars")
    )
    rows = rows.withColumn("range", F.expr(f"turn div {TURNS}"))
    counts = rows.groupBy("conv", "range").agg(F.count("*").alias("n"))
    order = [F.col("turn").asc_nulls_first(), "t1", "t2"]
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv", "range").orderBy(*order)))
    # conversations of one range need no shift, and are almost all
    before = F.sum("n").over(Window.partitionBy("conv").orderBy(F.col("range").asc_nulls_first())) - F.col("n")
    shifts = counts.select(F.col("conv").alias("c"), F.col("range").alias("r"), before.alias("before")).where("before > 0")
    placed = rows.join(shifts, (rows["conv"] == shifts["c"]) & rows["range"].eqNullSafe(shifts["r"]), "left")
    return placed.select("conv", (F.col("at") - 1 + F.coalesce("before", F.lit(0))).alias("rank"), "t1", "t2", "chars")


def grafted(turns: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Every conversation rebuilt: ``conv``, ``pos`` from 0, ``t1``, ``t2``, ``chars``; and all ids.

    The first h turns are those of the conversation ``conv - conv % 100`` (all if it has fewer, none
    if there is no such conversation), h being the CRC-32 of the id in decimals, modulo 6; the
    conversation's own turns after its first h follow."""
    h = (F.crc32(F.col("conv").cast("string")) % GRAFTED).cast("int")
    ids = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    heads = turns.where(F.col("rank") < GRAFTED - 1).select(F.col("conv").alias("base"), "rank", "t1", "t2", "chars")
    taken = ids.select("conv", "base", "h").join(heads, "base").where("rank < h")  # at most 5 rows of a base, 100 ids
    taken = taken.select("conv", F.col("rank").alias("pos"), "t1", "t2", "chars")
    kept = turns.withColumn("h", h).where("rank >= h").withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    # of 5 turns a base; read back, so that Spark splits a conversation of very many turns in the join
    sizes = space.keep(heads.groupBy("base").agg(F.max(F.col("rank") + 1).alias("head")), "heads")
    got = F.least("h", F.coalesce("head", F.lit(0)))
    kept = kept.join(sizes, "base", "left").select("conv", (F.col("rank") - F.col("h") + got).alias("pos"), "t1", "t2", "chars")
    return taken.unionByName(kept), ids.select("conv")


def blocks_of(turns: DataFrame, block: int) -> DataFrame:
    """``conv``, ``b``, ``turns`` (array by position of g1, g2, chars), ``k1``, ``k2`` (digest of the
    prefix before the block), ``e1``, ``e2`` (after it), ``size`` and ``last``."""
    placed = turns.select("conv", "pos", "chars", *[x.alias(n) for x, n in zip(_lanes(F.col("pos"), F.col("t1"), F.col("t2")), ("g1", "g2"))])
    blocks = placed.groupBy("conv", F.expr(f"cast(pos div {block} as long)").alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "g1", "g2", "chars"))).alias("turns"),  # of `block` turns at most
        F.bit_xor("g1").alias("x1"),
        F.bit_xor("g2").alias("x2"),
        F.count("*").alias("size"),
    )
    along = Window.partitionBy("conv").orderBy("b")
    ends = [F.bit_xor(x).over(along).alias(e) for x, e in (("x1", "e1"), ("x2", "e2"))]
    blocks = blocks.select("*", *ends, F.lead("b").over(along).isNull().alias("last"))
    return blocks.select("conv", "b", "turns", *[F.col(e).bitwiseXOR(F.col(x)).alias(k) for e, x, k in (("e1", "x1", "k1"), ("e2", "x2", "k2"))], "e1", "e2", "size", "last")


NODE = ["b", "e1", "e2", "size"]


def prefix_trie(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations (see ``grafted``), the root included:
    ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (code points), ``ends_sha256``.

    Turns are ordered by number, null first; turns of equal number by a hash of what is said, so that
    repeated rows are repeated turns and reruns agree. Null roles and texts are empty. A row without
    a conversation id belongs to no conversation. A conversation that is left without turns is a
    member of the root only. No conversations: no rows. Other columns aren't read.

    Texts are read once and never move; what moves is a digest per turn. Rows of one conversation
    are ranked by ranges of turn numbers, and blocks along a conversation are one row each. Members
    of one node meet in sums that are combined before the shuffle."""
    space = Workspace(df.sparkSession, "trie")
    turns = space.keep(ordered_turns(df, key, turn, role, text), "turns")
    rebuilt, ids = grafted(turns, space)
    ids = space.keep(ids, "ids")
    blocks = space.keep(blocks_of(rebuilt, block), "blocks")

    # conversations by their blocks
    nodes = blocks.groupBy(*NODE, "k1", "k2").agg(F.count("*").alias("n"), F.min("conv").alias("own"), F.sum(F.col("last").cast("long")).alias("ends"))
    nodes = space.keep(nodes, "nodes")
    families = nodes.groupBy("b", "k1", "k2").agg(F.count("*").alias("siblings")).where("siblings > 1")
    families = space.keep(families, "families")  # a family of very many is an equi-join side that Spark splits
    nodes = space.keep(nodes.join(families, ["b", "k1", "k2"], "left").withColumn("alone", F.col("siblings").isNull()).drop("siblings"), "nodes")

    # the turns of every block node, once, from its owner
    first = blocks.select(F.col("conv").alias("own"), "b", "turns").join(nodes, ["own", "b"])
    steps = first.select(*NODE, "k1", "k2", "own", "n", "ends", "alone", F.posexplode("turns").alias("j", "t"), "turns")
    xor = "aggregate(slice(turns, 1, j + 1), 0L, (a, t) -> a ^ t.{g})"
    ends_here = F.when(F.col("j") + 1 == F.col("size"), F.col("ends")).otherwise(0)
    steps = steps.select(
        *NODE, "k1", "k2", "own", "n", "alone", "j", (F.col("t.pos").cast("long") + 1).alias("depth"), F.col("t.chars").alias("chars"), ends_here.alias("ends"),
        F.col("k1").bitwiseXOR(F.expr(xor.format(g="g1"))).alias("p1"), F.col("k2").bitwiseXOR(F.expr(xor.format(g="g2"))).alias("p2"),
        F.col("k1").bitwiseXOR(F.expr("aggregate(slice(turns, 1, j), 0L, (a, t) -> a ^ t.g1)")).alias("q1"),
        F.col("k2").bitwiseXOR(F.expr("aggregate(slice(turns, 1, j), 0L, (a, t) -> a ^ t.g2)")).alias("q2"),
    )
    steps = space.keep(steps, "steps")  # p: the prefix up to the turn, q: the prefix before it

    # turn boundaries are compared inside families of siblings only
    point = ["depth", "p1", "p2"]
    chain = steps.where("alone").select(*point, F.col("own").alias("conv"), "n", "ends")
    refined = steps.where("not alone").groupBy(*point).agg(F.min("own").alias("conv"), F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    points = space.keep(chain.unionByName(refined), "points")

    # a point's row on its owner's block: (point, owner) is unique, so no side is crowded
    owner = points.select(*point, F.col("conv").alias("own"), F.col("n").alias("members"), F.col("ends").alias("stops"))
    placed = steps.join(owner, [*point, "own"], "left").withColumn("owned", F.col("members").isNotNull())
    leaf = (F.col("owned") & (F.col("members") == F.col("stops"))).cast("long")
    saved = F.when(F.col("owned"), (F.col("members") - 1) * F.col("chars")).otherwise(0)
    within = Window.partitionBy(*NODE).orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of `block` rows
    # the next turn of the block is a child that its owner counts
    child = F.coalesce(F.lag(F.col("owned").cast("long")).over(Window.partitionBy(*NODE).orderBy(F.col("j").desc())), F.lit(0))
    placed = placed.withColumn("leaf", leaf).withColumn("saved", saved).withColumn("child", child)
    placed = placed.withColumn("leaves_on", F.sum("leaf").over(within)).withColumn("saved_on", F.sum("saved").over(within))
    placed = space.keep(placed.drop("members", "stops"), "placed")

    # what follows a block: its owners' contributions, summed backwards along every conversation
    gains = placed.where("j = 0").select(F.col("own").alias("conv"), "b", F.col("leaves_on").alias("leaves"), F.col("saved_on").alias("tokens"))
    later = Window.partitionBy("conv").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.drop("turns").join(gains, ["conv", "b"], "left").select(
        *NODE, F.coalesce(F.sum("leaves").over(later), F.lit(0)).alias("leaves"), F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens")
    )
    after = space.keep(after.groupBy(*NODE).agg(F.sum("leaves").alias("leaves_after"), F.sum("tokens").alias("saved_after")), "after")
    summed = placed.join(after, NODE).groupBy(*point).agg(
        F.sum("child").alias("children"), F.sum(F.col("leaves_on") + F.col("leaves_after")).alias("n_leaves"), F.sum(F.col("saved_on") + F.col("saved_after")).alias("saved_tokens")
    )
    # first turns of blocks are children of the prefix before the block
    opened = placed.where("j = 0 AND owned").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("opened"))
    opened = space.keep(opened, "opened")
    # the parent of a point is the prefix before it, as its owner's row has it
    befores = placed.where("owned").select(*point, "q1", "q2")
    points = points.join(summed, point).join(opened, point, "left").join(befores, point)
    points = space.keep(points.withColumn("n_children", F.col("children") + F.coalesce("opened", F.lit(0))), "points")

    # the root
    talking = blocks.where("b = 0").select("conv")
    silent = ids.join(talking, "conv", "left_anti")
    zero, unknown = F.lit(0).cast("long"), F.lit(None).cast("long")
    members = ids.select("conv", F.lit(1).cast("long").alias("n"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    tops = points.where("depth = 1").select(unknown.alias("conv"), zero.alias("n"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    root = members.unionByName(tops).agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "n_children", "n_leaves", "saved_tokens")]).where("n > 0")
    root = root.select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv", "n", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens",
        unknown.alias("q1"), unknown.alias("q2"),
    )
    points = space.keep(points.select(*root.columns).unionByName(root), "points")

    stops = blocks.where("last").select("conv", (F.col("b") * block + F.col("size")).alias("depth"), F.col("e1").alias("p1"), F.col("e2").alias("p2"))
    stops = stops.unionByName(silent.select("conv", zero.alias("depth"), zero.alias("p1"), zero.alias("p2")))
    digests = space.keep(hashed_ids(stops, point), "ends")
    parents = points.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))
    # a parent of very many children is an equi-join side that Spark splits
    named = points.join(parents, ["depth", "q1", "q2"], "left").join(digests, point, "left")
    return named.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def hashed_ids(stops: DataFrame, point: list[str]) -> DataFrame:
    """``point`` and ``ends_sha256``: the SHA-256 of the ids (``conv``) of each point in ascending
    decimals, with commas between.

    Ids are different, so a range of IDS ids holds no more of them; ranges are joined where they
    meet, and a point's ranges stream through one hash in their order."""
    ranged = stops.groupBy(*point, F.floor(F.col("conv") / IDS).alias("range")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    ranged = ranged.select(*point, "range", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("part"))
    sent = ranged.repartition(*point).sortWithinPartitions(*point, "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            keys, digests = [], []
            for *own, _, part in zip(*[c.to_pylist() for c in batch.columns]):
                if own != at:
                    if at is not None:
                        keys.append(at)
                        digests.append(digest.hexdigest())
                    at, digest = own, hashlib.sha256(part.encode())
                else:
                    digest.update(b"," + part.encode())
            yield table(keys, digests)
        if at is not None:
            yield table([at], [digest.hexdigest()])

    def table(keys: list[list[int]], digests: list[str]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(len(point))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], [*point, "ends_sha256"])

    return sent.mapInArrow(run, ", ".join(f"{p} long" for p in point) + ", ends_sha256 string")
