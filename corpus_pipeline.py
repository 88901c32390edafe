"""From raw documents to shards: toxic documents out, one of each near-duplicate group, no benchmark
items, sources mixed to their weights, and equal shards.

``STAGES`` in order; each works on all that the one before kept. Rows without a text count as empty
texts in every stage, rows without an id or a source are kept like others, repeated rows are copies
of each other, an empty table stays empty, and all but the last stage return the columns they got."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inversia.llm import decontaminate, mixing, nearcopies, shards, toxicity
from inversia.llm.workspace import Workspace, read_table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from ``labels`` of these documents.
    Without labels of both kinds it calls all texts the kind that it knows, clean if none."""
    model = toxicity.fit_toxicity(toxicity.training_rows(docs, read_table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, null ids last. SimHash finds
    copies and light edits, a second search all other pairs; every link is confirmed to be of
    likeness 0.8 or more over five-word shingles. Texts without words are one group."""
    return nearcopies.drop_near_copies(docs)


def remove_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; equal texts fare alike, empty ones hold none."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, 0 to 3 times. Null is a source of its own."""
    return mixing.mix_documents(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ``shard`` and ``slot``, which replace columns of those names."""
    return shards.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_copies),
    ("decontamination", remove_benchmark_items),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

# a fitted classifier decides the first stage, which SQL can't express
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    space = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
