"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams in the whole text, each times the log ratio of its
smoothed frequency in toxic and in clean labelled texts; a logistic model is fitted on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.llm.decontaminate import small
from inversia.llm.linear import fit_sparse, sigmoid
from inversia.llm.ngrams import Presence
from inversia.llm.workspace import Workspace, few_at_once, held_out, per_batch

LENGTHS, BITS = (4, 5), 18
SMOOTHING, L2 = 1.0, 1e-3
#: About so many labelled rows are fitted on; ratios are counted on all.
MOST_TRAINING = 12_000


@dataclass
class ToxicityModel:
    weights: np.ndarray
    intercept: float

    def scorer(self) -> Callable[[str | None], float]:
        """A function from text to probability, for one task."""
        present = Presence(LENGTHS, BITS)
        return lambda text: sigmoid(self.intercept + float(self.weights[present(text or "")].sum()))


def fit_toxicity(labelled: DataFrame, text: str = "text", label: str = "toxic", most: int = MOST_TRAINING) -> ToxicityModel:
    """Learn from rows with a text and a 0/1 label; others are left out.

    The ratios are counted on all rows, the logistic model is fitted on about ``most`` of them, on
    every n-gram they hold. No rows, or one class only: a model that calls every text that class
    (clean if none)."""
    key = F.xxhash64(*[labelled[c] for c in labelled.columns if c != text])
    rows = labelled.select(labelled[text].alias("text"), labelled[label].cast("double").alias("label"), key.alias("key"))
    rows = rows.where("text is not null and label in (0.0, 1.0)")

    spark = labelled.sparkSession
    space = Workspace(spark, "toxicity")
    texts = space.keep(rows, "texts")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        # log-odds of 6 for the only class seen
        return ToxicityModel(np.zeros(1 << BITS), 6.0 if sizes.get(1.0) else -6.0)
    with few_at_once(spark):
        counts = presence_counts(texts)
    ratios = np.where(counts.any(0), log_ratios(counts, (sizes[0.0], sizes[1.0])), 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Presence(LENGTHS, BITS)
        for batch in batches:
            found = pa.array([present(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), found], ["label", "weight", "i"])

    with few_at_once(spark):
        training = space.keep(fitted_rows(texts, sizes, most).mapInArrow(features, "label double, weight double, i array<int>"), "features")
    coefficients, intercept = fit_sparse(training, ratios, L2)
    space.drop(texts, training)
    return ToxicityModel(coefficients * ratios, intercept)


def fitted_rows(texts: DataFrame, sizes: dict[float, int], most: int) -> DataFrame:
    """``text``, ``label``, ``weight`` of about ``most`` rows, chosen by a hash of the row.

    A class of at most half as many is taken whole; a class that is thinned weighs as much as all its rows."""
    shares = {c: min(1.0, max(most / 2, most - sizes[1.0 - c]) / n) for c, n in sizes.items()}
    share = F.when(F.col("label") == 1.0, F.lit(shares[1.0])).otherwise(F.lit(shares[0.0]))
    place = F.pmod(F.xxhash64(F.lit(7), "key", "text"), F.lit(1 << 52)) / float(1 << 52)
    return texts.where(place < share).select("text", "label", (1.0 / share).alias("weight"))


def presence_counts(texts: DataFrame) -> np.ndarray:
    """In how many clean (row 0) and toxic (row 1) texts each feature is present; tasks send sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, own = Presence(LENGTHS, BITS), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own[int(label)][present(text)] += 1
        found = np.flatnonzero(own.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(own[0][found]), pa.array(own[1][found])], ["f", "clean", "toxic"])

    table = texts.mapInArrow(sums, "f int, clean long, toxic long")
    table = table.groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, 1 << BITS))
    counts[:, table["f"].to_numpy()] = table["clean"].to_numpy(), table["toxic"].to_numpy()
    return counts


def log_ratios(counts: np.ndarray, sizes: tuple[int, int] | None = None) -> np.ndarray:
    """Log of the smoothed share of each feature in toxic texts over that in clean ones: of the
    ``sizes`` texts of each class if given, else of all the features found there."""
    shares = counts + SMOOTHING
    shares /= shares.sum(1, keepdims=True) if sizes is None else np.array(sizes, float)[:, None] + 2 * SMOOTHING
    return np.log(shares[1] / shares[0])


def training_rows(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Key, ``text`` and label of all labelled rows outside the held-out fold (null keys: none)."""
    known = labels.select(labels[key].alias("doc_id"), labels[label].alias("label"))
    known = small(known.where(known["label"].isNotNull() & known["doc_id"].isNotNull() & ~held_out(known["doc_id"])))
    texts = df.select(df[key].alias("doc_id"), df[text].alias("text"))
    return texts.join(known, "doc_id").select("doc_id", "text", F.col("label").alias(label))


def score_toxicity(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` of every row, from its text alone.

    Null and empty texts get the score of a text without features. Null and repeated keys stay."""
    narrow = df.select(df[key].alias("doc_id"), held_out(df[key]).alias("held_out"), df[text].alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        score = sent.value.scorer()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [score(t) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

        return work

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return per_batch(narrow, make, f"doc_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", key)


def drop_toxic(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``threshold``, all their columns, in one pass."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = sent.value.scorer()
        for texts in batches:
            yield pa.array([score(t) for t in texts.to_pylist()], pa.float64())

    return df.where(scores(df[text]) < threshold)
