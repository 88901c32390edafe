"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.llm.ngrams import blocks, hashed
from inversia.llm.workspace import held_out, per_batch

LENGTHS, BITS, SMOOTHING = (1, 2, 3), 15, 0.1
#: A broadcast matrix has so many languages at most (x 2**BITS x 4 bytes); more languages, more matrices.
AT_ONCE = 500
#: A column of more different values is no column of languages.
MOST_LANGUAGES = 50_000
#: Matrix entries gathered at once while scoring.
GATHERED = 1 << 20
UNDETERMINED = "und"


class LanguageModel:
    """``languages`` and their log probabilities, one row per bucket."""

    def __init__(self, languages: list[str], log_priors: np.ndarray, log_likelihoods: np.ndarray, bits: int = BITS):
        self.languages, self.log_priors, self.log_likelihoods, self.bits = languages, log_priors, log_likelihoods, bits

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of a text's n-grams, ascending, and how often each comes."""
        counts = np.zeros(1 << self.bits, np.int64)
        for points in blocks(text, max(LENGTHS)):
            counts += np.bincount(hashed(points, LENGTHS, self.bits), minlength=1 << self.bits)
        found = np.flatnonzero(counts)
        return found, counts[found]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log joint of each text with each language: its n-grams' rows of the matrix, summed. The
        sparse rows of many texts are one list of entries, gathered and added up by text."""
        out = np.repeat(self.log_priors[None].astype(np.float64), len(texts), 0)
        rows, buckets, counts, held = [], [], [], 0
        most = max(1, GATHERED // max(1, len(self.languages)))

        def add() -> None:
            row, bucket, count = np.concatenate(rows), np.concatenate(buckets), np.concatenate(counts)
            for at in range(0, len(row), most):
                own = row[at : at + most]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                entries = self.log_likelihoods[bucket[at : at + most]].astype(np.float64) * count[at : at + most, None]
                out[own[first]] += np.add.reduceat(entries, first)

        for i, text in enumerate(texts):
            found, n = self.counted(text)
            if len(found):
                rows.append(np.full(len(found), i))
                buckets.append(found)
                counts.append(n)
                held += len(found)
            if held >= most:
                add()
                rows, buckets, counts, held = [], [], [], 0
        if held:
            add()
        return out


def determinable(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit_language(
    df: DataFrame, text: str = "text", lang: str = "lang", at_once: int = AT_ONCE, bits: int = BITS
) -> list[LanguageModel]:
    """Counts of every n-gram of every row with a text and a language, summed by Spark: all languages,
    in models of at most ``at_once``.

    Each task sums its own rows into one array per language; only (language, bucket, count) rows
    are shuffled. For each model the driver gets at most ``at_once`` x 2**bits sums. No rows: no models."""
    known = df.select(df[text].alias("text"), df[lang].alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} different values")
    names, total = sorted(sizes), sum(sizes.values())
    parts = [names[i : i + at_once] for i in range(0, len(names), at_once)]
    models = []
    for languages in parts:
        own = known if len(parts) == 1 else known.where(F.col("lang").between(languages[0], languages[-1]))
        counts = _counts(own, languages, bits) + SMOOTHING
        priors = np.log(np.array([sizes[name] for name in languages], float) / total)
        models.append(LanguageModel(languages, priors, np.log(counts / counts.sum(0)).astype(np.float32), bits))
    return models


def _counts(known: DataFrame, languages: list[str], bits: int) -> np.ndarray:
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name in place:
                    own = sums.setdefault(place[name], np.zeros(1 << bits, np.int64))
                    for points in blocks(t, max(LENGTHS)):
                        own += np.bincount(hashed(points, LENGTHS, bits), minlength=1 << bits)
        for k, own in sums.items():
            found = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), k, np.int32)), pa.array(found.astype(np.int32)), pa.array(own[found])],
                ["k", "bucket", "n"],
            )

    parts = known.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << bits, len(languages)))
    counts[parts["bucket"].to_numpy(), parts["k"].to_numpy()] = parts["n"].to_numpy()
    return counts


STATE = ["best", "best_log", "log_sum"]


def _scored(rows: DataFrame, model: LanguageModel, first: bool) -> DataFrame:
    """Rows (doc_id, held_out, text) with the best language so far, its log joint, and the log of the
    sum of all languages' joints; null for undeterminable texts."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = sent.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).to_pylist()
            clear = [i for i, t in enumerate(texts) if determinable(t)]
            best, best_log, log_sum = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            if not first:
                best, best_log, log_sum = (batch.column(c).to_pylist() for c in range(3, 6))
            logs = own.scores([texts[i] for i in clear])
            top = logs.argmax(1) if len(clear) else []
            for i, log, k in zip(clear, logs, top):
                whole = float(np.logaddexp.reduce(log))
                if best[i] is None or log[k] > best_log[i]:
                    best[i], best_log[i] = own.languages[k], float(log[k])
                log_sum[i] = whole if log_sum[i] is None else float(np.logaddexp(log_sum[i], whole))
            found = [pa.array(best, pa.string()), pa.array(best_log, pa.float64()), pa.array(log_sum, pa.float64())]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *found], ["doc_id", "held_out", "text", *STATE])

        return work

    kind = rows.schema["doc_id"].dataType.simpleString()
    return per_batch(rows, make, f"doc_id {kind}, held_out boolean, text string, best string, best_log double, log_sum double")


def predict_language(df: DataFrame, models: list[LanguageModel], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``lang_pred``, ``score`` of every row, from its text alone.

    Null texts and texts without a letter: ``und`` with score 0, as everything if no language was
    learned. Of equally likely languages the first by name. Null and repeated keys stay."""
    rows = df.select(df[key].alias("doc_id"), held_out(df[key]).alias("held_out"), df[text].alias("text"))
    for i, model in enumerate(models):  # in one stage, a matrix each
        rows = _scored(rows, model, i == 0)
    if not models:
        rows = rows.select("*", F.lit(None).cast("string").alias("best"), *[F.lit(None).cast("double").alias(c) for c in STATE[1:]])
    return rows.select(
        F.col("doc_id").alias(key), "held_out", F.coalesce("best", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce(F.exp(F.col("best_log") - F.col("log_sum")), F.lit(0.0)).alias("score"),
    )


def identify_language(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out, predict all."""
    return predict_language(df, fit_language(df.where(~held_out(df[key])), text, lang), key, text)
