"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Targets: sources weigh WEIGHTS in the order of their names and share all tokens; a target stops at
MOST times its source's tokens and the excess is shared again.

Rates: among all rates r of a source's documents that meet its target, balancing takes those of
least relative entropy to one copy each, with rates between 0 and MOST. Its dual is convex with one
variable per source, and its solution tilts exponentially by length:

    r = MOST / (1 + (MOST - 1) * exp(-tilt * size / mean size))

Newton steps find the tilts. They are guarded by a bracket: a step that leaves it is halved into it.
Each step is one aggregate over the (source, size) classes, in which documents of equal rate are
counted once, by decimals, so that every run gives the same sums.

Copies: expected copies are added up from the longest class to the shortest and the running sum is
rounded, so no rounding error is carried on; what a source still misses or exceeds is then made up
by single copies, from the longest class that fits downwards. Within a class the documents with the
smallest seeded hashes get the odd copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inversia.llm.shards import RUN, shuffle_key
from inversia.llm.workspace import Workspace, word_count

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mixing-1"
STEPS, CLOSE = 60, 1e-5
PASSES = 6
#: Rows of a class are ranked within this many parts, so that no class is one task.
SALTS = 256
ONE = 1 << 20  # rates are rounded to this fraction of a copy


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source with ``source_size`` (long).

    Null is the last source. Sources are few beside documents: one row each, ranked in one window."""
    exact = "decimal(38,0)"
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast(exact).alias("w"), (F.col("source_size") * most).cast(exact).alias("cap"))
    # the sources that stop at their cap come first in the order of cap by weight
    by = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast(exact)
    rows = rows.select(
        "*",
        F.row_number().over(by).alias("place"),
        (F.sum(F.col("source_size").cast(exact)).over(everything) - F.coalesce(F.sum("cap").over(before), zero)).cast(exact).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero)).cast(exact).alias("left_w"),
    )
    # the first one that doesn't stop: its share of what is left is not above its cap
    open_ = F.col("w").cast("double") * F.col("left").cast("double") < F.col("cap").cast("double") * F.col("left_w").cast("double")
    first = F.min(F.when(open_, F.struct("place", "left", "left_w"))).over(everything)
    rows = rows.withColumn("first", first)
    share = F.col("w").cast("double") * F.col("first.left").cast("double") / F.col("first.left_w").cast("double")
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return rows.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def rate(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    """Copies expected of a document of this size; a null tilt stands for no bound: ``most``."""
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * size / mean))
    return F.when(tilt.isNull(), F.lit(float(most))).otherwise(F.lit(float(most)) / (1.0 + (most - 1.0) * F.exp(-x)))


def balance(classes: DataFrame, goals: DataFrame, space: Workspace, most: int = MOST) -> DataFrame:
    """``source``, ``tilt``, ``mean`` from classes (source, size, n) and goals (source, target).

    Distributed Newton on the dual. A source whose target is ``most`` times its size has a null
    tilt; one without tokens has tilt 0."""
    real = classes.where("size > 0")
    means = real.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    start = goals.alias("g").join(means.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source")), "left").select(
        "g.source", "target", "source_size", F.coalesce("mean", F.lit(1.0)).alias("mean")
    )
    at_cap = F.col("target") >= F.col("source_size") * float(most) * (1 - 1e-12)
    start = start.select(
        "*",
        F.when(at_cap & (F.col("source_size") > 0), F.lit(None).cast("double")).otherwise(F.lit(0.0)).alias("tilt"),
        # beyond these the shortest document's rate is at its bound as far as doubles tell
        (F.col("mean") * -700.0).alias("low"),
        (F.col("mean") * 700.0).alias("high"),
        (at_cap | (F.col("source_size") == 0)).alias("done"),
    )
    state = space.keep(start, "tilts")
    for _ in range(STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        moving = state.where(~F.col("done"))
        tokens = F.col("size") * F.col("n")
        r = rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
        sums = (
            real.alias("c")
            .join(moving.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
            .groupBy("s.source")
            .agg(
                F.sum((tokens * r).cast("decimal(30,6)")).cast("double").alias("met"),
                F.sum((tokens * (F.col("size") / F.col("mean")) * r * (1 - r / most)).cast("decimal(32,6)")).cast("double").alias("slope"),
            )
        )
        joined = state.alias("t").join(sums.alias("u"), F.col("t.source").eqNullSafe(F.col("u.source")), "left").select("t.*", "met", "slope")
        short = F.col("met") < F.col("target")
        low = F.when(short, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(short, F.col("high")).otherwise(F.col("tilt"))
        joined = joined.select(
            "source", "target", "source_size", "mean", "tilt", "done", "met", "slope",
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
        )
        step = F.col("tilt") + F.when(F.col("slope") > 0, (F.col("target") - F.col("met")) / F.col("slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        met = F.abs(F.col("met") - F.col("target")) <= CLOSE * F.greatest("target", F.lit(1.0))
        settled = F.col("done") | met
        state_next = joined.select(
            "source", "target", "source_size", "mean",
            F.when(settled, F.col("tilt")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"),
            "low", "high", settled.alias("done"),
        )
        following = space.keep(state_next, "tilts")
        space.drop(state)
        state = following
    return state


def whole_copies(classes: DataFrame, tilts: DataFrame, space: Workspace, most: int = MOST) -> DataFrame:
    """``source``, ``size``, ``n``, ``copies`` (of the whole class together), near every target."""
    rates = classes.alias("c").join(tilts.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        "c.source", "size", "n", "target",
        F.round(rate(F.col("tilt"), F.col("size"), F.col("mean"), most) * ONE).cast("long").alias("q"),
    )
    longest_first = Window.partitionBy("source").orderBy(F.desc("size"))
    upto = F.sum(F.col("n") * F.col("q")).over(longest_first)
    rounded = lambda x: F.floor((x + ONE // 2) / F.lit(ONE))
    exact = rates.withColumn("upto", upto).select(
        "source", "size", "n", "target", (rounded(F.col("upto")) - rounded(F.col("upto") - F.col("n") * F.col("q"))).alias("copies")
    )
    state = space.keep(exact, "copies")
    for _ in range(PASSES):
        missing = state.groupBy("source", "target").agg((F.round(F.first("target")) - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("missing"))
        rows = state.alias("a").join(missing.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
            "a.source", "size", "n", "a.target", "copies", "missing"
        )
        gap = F.abs("missing")
        room = F.when(F.col("missing") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        usable = F.when((F.col("size") > 0) & (F.col("size") <= gap), F.greatest(room, F.lit(0))).otherwise(F.lit(0))
        rows = rows.withColumn("usable", usable).withColumn("upto", F.sum(F.col("usable") * F.col("size")).over(longest_first))
        earlier = F.col("upto") - F.col("usable") * F.col("size")
        change = F.least(F.col("usable"), F.greatest(F.lit(0).cast("long"), F.expr("(abs(missing) - (upto - usable * size)) div greatest(size, 1L)")))
        change = F.when(earlier < gap, change).otherwise(F.lit(0))
        following = space.keep(rows.select("source", "size", "n", "target", (F.col("copies") + F.signum("missing") * change).cast("long").alias("copies")), "copies")
        space.drop(state)
        state = following
    return state


def measured(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """The rows as ``place_copies`` wants them: ``row`` (a struct), source, size, hash, ties, and how
    many equal rows each stands for."""
    return df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        df[source].cast("string").alias("source"),
        word_count(df[text]).alias("size"),
        shuffle_key(df[key], seed).alias("h"),
        df[key].alias("key"),
        F.crc32(F.coalesce(df[text], F.lit(""))).alias("crc"),
        F.lit(1).cast("long").alias("times"),
    )


def place_copies(rows: DataFrame, space: Workspace, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``row``, ``size``, ``source_size``, ``target``, ``copies`` of every measured row, and the number
    of rows (``times``) of that row that it holds for.

    ``size`` is the number of words of the text (null: 0). Null is a source of its own, the last.
    Equal rows may get different copies, in sum the same on every run. No rows: no rows."""
    classes = space.keep(rows.groupBy("source", "size").agg(F.sum("times").alias("n")), "classes")
    sums = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = space.keep(targets(sums, weights, most), "targets")
    tilts = balance(classes, goals, space, most)
    decided = whole_copies(classes, tilts, space, most)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("h", "crc"), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy("source", "size", "salt").agg(F.sum("times").alias("m"))
    parts = parts.withColumn("before", F.sum("m").over(Window.partitionBy("source", "size").orderBy("salt")) - F.col("m"))
    parts = parts.alias("p").join(decided.alias("d"), F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.size") == F.col("d.size")))
    parts = parts.join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select(
        "p.source", "p.size", "salt", "before", "n", "copies", "g.source_size", "g.target"
    )
    inside = Window.partitionBy("source", "size", "salt").orderBy("h", "key", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("upto", F.sum("times").over(inside)).alias("r")
    same = F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.size") == F.col("q.size")) & (F.col("r.salt") == F.col("q.salt"))
    placed = ranked.join(parts.alias("q"), same)
    # of the rows that a row stands for, so many get one copy more than the others
    more = F.least(F.col("times"), F.greatest(F.lit(0).cast("long"), F.expr("copies % n - (upto - times + before)")))
    each = F.array(F.struct(more.alias("times"), F.expr("cast(copies div n + 1 AS int)").alias("copies")), F.struct((F.col("times") - more).alias("times"), F.expr("cast(copies div n AS int)").alias("copies")))
    split = placed.select("row", "r.size", "source_size", "target", F.explode(F.filter(each, lambda x: x["times"] > 0)).alias("e"))
    return split.select("row", "size", "source_size", "target", F.col("e.times").alias("times"), F.col("e.copies").alias("copies"))


def mix_documents(df: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, **columns: str) -> DataFrame:
    """The mixture: every row as many times as it has copies, with the input's columns."""
    mixed = place_copies(measured(df, **columns), Workspace(df.sparkSession, "mixing"), weights, most).where("copies > 0")
    repeated = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))  # whole rows stand for themselves
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def digest_mix(df: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row; ``taken`` counts repeats.

    What decides is a few numbers a row, written once so that texts are read once; rows equal in them
    are one row and a count, and come back in runs."""
    space = Workspace(df.sparkSession, "mixing")
    rows = measured(df.select("doc_id", "source", "text"))
    narrow = rows.withColumn("row", F.struct(F.col("row.doc_id").alias("doc_id")))
    equal = [c for c in narrow.columns if c != "times"]
    narrow = space.keep(narrow.groupBy(*equal).agg(F.sum("times").alias("times")), "sizes")
    mixed = place_copies(narrow, space)
    runs = mixed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {RUN}"))))
    few, many = runs.where(F.col("times") <= RUN), runs.where(F.col("times") > RUN).repartition("run")
    left = F.least(F.lit(RUN).cast("long"), F.col("times") - F.col("run") * RUN)
    whole = few.unionByName(many).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return whole.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )
