"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.llm.workspace import Workspace


def connected_components(links: DataFrame, space: Workspace) -> DataFrame:
    """``node``, ``label`` (the smallest node it reaches) for every node of ``links`` (a, b: numbers or
    texts).

    Alternating large and small stars: each round links every node's neighbours to the smallest one,
    until the table stands still as one star per component. A round never has more links than
    before. Minima are combined before they are shuffled, and a node with many links is an equi-join
    side that Spark splits. Links of a node with itself say nothing; no links: no rows."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = space.keep(links, "links")
    mark = _mark(state)
    while mark[0]:
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every node is linked to its smallest neighbour, and its other neighbours to that one too
        small = small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        following = space.keep(small, "links")
        space.drop(state)
        state, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def _mark(links: DataFrame) -> tuple:
    """What tells two tables of links apart: rows and a sum of hashes."""
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return (r["n"], r["s"])
