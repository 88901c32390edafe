"""Quality by co-training: a text classifier and a metadata classifier teach each other.

Both views start from the same labelled rows. In each round each view scores an unlabelled pool and
hands its most confident rows, with their pseudo-labels, to the other view's training rows. In the
end each view's log-odds are calibrated on labelled rows that it was not fitted on, and the mean of
the calibrated log-odds scores every document."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.llm.decontaminate import small
from inversia.llm.linear import bounded, fit_sparse, sigmoid
from inversia.llm.ngrams import hashed
from inversia.llm.workspace import Workspace, held_out, per_batch

#: Text features: 2**BITS hashed n-gram shares, and these lengths.
LENGTHS, BITS = (1, 2, 3), 12
METADATA_BITS = 10
ROUNDS, PER_ROUND, CONFIDENT = 2, 400, 0.9
#: About so many labelled rows are fitted on; any unlabelled row may get a pseudo-label.
MOST_TRAINING = 8_000
TEXT_L2, METADATA_L2 = 1e-4, 1e-3
SCALE = 20.0


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the shares of hashed characters and n-grams (punctuation kept), plus how
    much words repeat: the last feature is the share of different words."""
    counts = np.zeros(1 << BITS)
    text = text or ""
    for points in raw_blocks(text):
        counts += np.bincount(hashed(points, LENGTHS, BITS), minlength=1 << BITS)
    found = np.flatnonzero(counts)
    tokens = text.split()
    different = len(set(tokens)) / len(tokens) if tokens else 0.0
    values = np.sqrt(counts[found] / max(1.0, counts.sum())) * SCALE
    return np.append(found, 1 << BITS).astype(np.int32), np.append(values, different)


def raw_blocks(text: str) -> list[np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    step = 1 << 20
    return [points[i : i + step + max(LENGTHS) - 1] for i in range(0, len(points), step)]


def metadata_features(source: str | None, lang: str | None, length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indicators of source, language, size class and the pairs of them."""
    size = "none" if length is None else str(int(2 * math.log2(1 + max(0, length))))
    facts = [f"s:{source}", f"l:{lang}", f"n:{size}", f"ln:{lang}:{size}", f"sl:{source}:{lang}"]
    indices = sorted({bucket(f) for f in facts})
    return np.array(indices, np.int32), np.ones(len(indices))


def bucket(fact: str) -> int:
    return zlib.crc32(fact.encode("utf-8", "surrogatepass")) & ((1 << METADATA_BITS) - 1)


@dataclass
class View:
    """A linear model and its calibration (log-odds to calibrated log-odds)."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, indices: np.ndarray, values: np.ndarray) -> float:
        return self.intercept + float(self.weights[indices] @ values)

    def calibrated(self, indices: np.ndarray, values: np.ndarray) -> float:
        return self.slope * self.log_odds(indices, values) + self.offset


@dataclass
class QualityModel:
    text: View
    metadata: View
    rounds: list[dict] = field(default_factory=list)

    def score(self, text: str | None, source: str | None, lang: str | None, length: int | None) -> float:
        a = self.text.calibrated(*text_features(text))
        b = self.metadata.calibrated(*metadata_features(source, lang, length))
        return sigmoid((a + b) / 2)


VIEWS = {"text": (1 << BITS) + 1, "metadata": 1 << METADATA_BITS}
L2 = {"text": TEXT_L2, "metadata": METADATA_L2}


def _fitted(rows: DataFrame, view: str) -> View:
    sparse = rows.select("label", F.lit(1.0).alias("weight"), F.col(f"{view}_i").alias("i"), F.col(f"{view}_v").alias("v"))
    return View(*fit_sparse(sparse, np.ones(VIEWS[view]), L2[view]))


def _scored(rows: DataFrame, views: dict[str, View]) -> DataFrame:
    """Log-odds of both views beside the rows' keys and labels."""
    sent = rows.sparkSession.sparkContext.broadcast(views)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {}
            for view, model in sent.value.items():
                pairs = zip(batch.column(f"{view}_i").to_pylist(), batch.column(f"{view}_v").to_pylist())
                out[view] = pa.array([model.log_odds(np.array(i), np.array(v)) for i, v in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("label"), batch.column("part"), out["text"], out["metadata"]],
                ["row", "label", "part", "text", "metadata"],
            )

    return rows.mapInArrow(score, "row long, label double, part int, text double, metadata double")


def _scored_pool(pool: DataFrame, views: dict[str, View]) -> DataFrame:
    """``row`` and the log-odds of both views of every row, from its text and metadata, in one pass."""
    sent = pool.sparkSession.sparkContext.broadcast(views)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, metadata = sent.value["text"], sent.value["metadata"]
        for batch in batches:
            a = [text.log_odds(*text_features(t)) for t in batch.column("text").to_pylist()]
            facts = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            b = [metadata.log_odds(*metadata_features(*x)) for x in facts]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(a, pa.float64()), pa.array(b, pa.float64())], ["row", "text", "metadata"])

    return pool.select("row", "text", "source", "lang", "n_chars").mapInArrow(score, "row long, text double, metadata double")


def _featurised(rows: DataFrame) -> DataFrame:
    """Features of both views beside ``row``, ``label`` and ``part``."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_features(t) for t in batch.column("text").to_pylist()]
            facts = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            metadata = [metadata_features(*x) for x in facts]
            ints, floats = pa.list_(pa.int32()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("label"),
                    batch.column("part"),
                    pa.array([x[0] for x in texts], ints),
                    pa.array([x[1] for x in texts], floats),
                    pa.array([x[0] for x in metadata], ints),
                    pa.array([x[1] for x in metadata], floats),
                ],
                ["row", "label", "part", "text_i", "text_v", "metadata_i", "metadata_v"],
            )

    columns = ["row", "text", "source", "lang", "n_chars", "label", "part"]
    schema = "row long, label double, part int, text_i array<int>, text_v array<double>, metadata_i array<int>, metadata_v array<double>"
    return rows.select(columns).mapInArrow(featurise, schema)


def fit_quality(labelled: DataFrame, unlabelled: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> QualityModel:
    """Co-train on ``labelled`` (doc_id, text, source, lang, n_chars, label) and ``unlabelled`` rows.

    In each of ``rounds`` each view gives the other about ``per_round`` pseudo-labels, those it is
    surest of; equally sure rows come by a hash of the row.

    Labelled rows are bounded by the caller (``training_rows``). Each round scores all unlabelled
    rows in one pass; only those that get a pseudo-label are opened for the fits. One class only, or
    no rows: constant views. One labelled row in four is kept from the fits and calibrates the views."""
    space = Workspace(labelled.sparkSession, "quality")

    # part 0: fitted on; 1: calibrates; 2: the pool
    part = F.when(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(4)) == 0, 1).otherwise(0)
    row = _row()
    rows = space.keep(_featurised(labelled.withColumns({"part": part, "row": row})), "features")
    known, check = (rows.where(F.col("part") == k) for k in (0, 1))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        odds = 6.0 if sizes.get(1.0) else -6.0 if sizes else 0.0
        space.drop(rows)
        return QualityModel(*(View(np.zeros(VIEWS[v]), odds) for v in ("text", "metadata")))
    share = sizes[1.0] / (sizes[0.0] + sizes[1.0])
    pool = space.keep(unlabelled.select(row.alias("row"), "text", "source", "lang", "n_chars"), "pool")
    given: dict[str, dict[int, float]] = {"text": {}, "metadata": {}}  # bounded: 2 * per_round rows a round
    views: dict[str, View] = {}
    told, added = [], []
    for n in range(rounds + 1):
        for view in VIEWS:
            views[view] = _fitted(_with_pseudo_labels(known, added[-1] if added else None, given[view]), view)
        if n == rounds:
            break
        # repeated rows are one row
        each = _scored_pool(pool, views).groupBy("row").agg(F.max("text").alias("text"), F.max("metadata").alias("metadata"))
        scores = space.keep(each, "scores")
        for view, other in (("text", "metadata"), ("metadata", "text")):
            chosen = _most_confident(scores, view, given[other], share, per_round)
            given[other] |= chosen
            told.append({"round": n, "from": view, "rows": len(chosen), "positive": sum(chosen.values())})
        space.drop(scores)
        added.append(space.keep(_chosen(pool, set(given["text"]) | set(given["metadata"])), "chosen"))
    found = _scored(check, views).where("label is not null").toPandas()
    for view, model in views.items():
        model.slope, model.offset = platt(found[view].to_numpy(), found["label"].to_numpy())
    space.drop(rows, pool, *added)
    return QualityModel(views["text"], views["metadata"], told)


def _chosen(pool: DataFrame, rows: set[int]) -> DataFrame:
    """The features of the few rows that got a pseudo-label from either view."""
    table = pool.sparkSession.createDataFrame([(r,) for r in sorted(rows)], "row long")
    few = pool.join(F.broadcast(table), "row").groupBy("row").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("one"))
    return _featurised(few.select("row", "one.*", F.lit(None).cast("double").alias("label"), F.lit(2).alias("part")))


def _with_pseudo_labels(known: DataFrame, chosen: DataFrame | None, given: dict[int, float]) -> DataFrame:
    if chosen is None or not given:
        return known
    table = known.sparkSession.createDataFrame(list(given.items()), "row long, given double")
    added = chosen.drop("label").join(F.broadcast(table), "row").withColumnRenamed("given", "label")
    return known.unionByName(added.select(known.columns))


def _most_confident(scores: DataFrame, view: str, taken: dict[int, float], share: float, per_round: int) -> dict[int, float]:
    """Up to ``per_round`` rows that ``view`` is surest of, classes in the labelled rows' proportion."""
    least = math.log(CONFIDENT / (1 - CONFIDENT))
    out: dict[int, float] = {}
    for label, order, n in ((1.0, F.desc(view), round(per_round * share)), (0.0, F.asc(view), round(per_round * (1 - share)))):
        sure = scores.where(F.col(view) >= least if label else F.col(view) <= -least)
        best = sure.orderBy(order, "row").limit(n + len(taken)).select("row").collect()
        out |= {r["row"]: label for r in [r for r in best if r["row"] not in taken][:n]}
    return out


def platt(log_odds: np.ndarray, labels: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on log-odds, by damped Newton steps with a small ridge."""
    if len(labels) < 10 or labels.min() == labels.max():
        return 1.0, 0.0
    x = np.stack([log_odds, np.ones_like(log_odds)], 1)
    prior, w = np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0.0, z) - labels * z) + 0.05 * np.sum((w - prior) ** 2))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - labels) + 0.1 * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return (float(max(w[0], 0.0)), float(w[1]))


def _row():
    return F.xxhash64(F.lit(13), "doc_id", "text")


def training_rows(df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = MOST_TRAINING) -> tuple[DataFrame, DataFrame]:
    """About ``most`` different labelled rows and all unlabelled rows outside the held-out fold.

    What bounds the labelled rows is a hash of the row, not of the key, so a key of very many rows
    counts as what it has; repeated rows come once for each label. Rows are chosen by hashes before
    any text moves. Rows without a key have no label and are in the pool."""
    docs = df.select(*[df[c].alias(n) for c, n in ((key, "doc_id"), ("text", "text"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars"))])
    docs = docs.withColumn("n_chars", F.col("n_chars").cast("long")).where(~held_out(F.col("doc_id")))
    own = labels.select(labels[key].alias("doc_id"), labels[label].cast("double").alias("label"))
    own = small(own.where("doc_id is not null and label in (0.0, 1.0)").distinct())
    rows = docs.where("doc_id is not null").select("doc_id", _row().alias("row")).distinct().join(own, "doc_id")
    space = Workspace(df.sparkSession, "labelled")
    chosen = space.keep(bounded(space.keep(rows, "rows"), "row", most).select("row", "label"), "chosen")
    met = docs.withColumn("row", _row()).join(F.broadcast(chosen), "row")  # of about `most` hashes
    known = met.groupBy("row", "label").agg(F.min(F.struct("doc_id", "text", "source", "lang", "n_chars")).alias("one")).select("one.*", "label")
    keyed = docs.where("doc_id is not null").join(own, "doc_id", "left_anti")
    return known, keyed.unionByName(docs.where("doc_id is null"))


def score_quality(df: DataFrame, model: QualityModel, key: str = "doc_id") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` of every row.

    Null texts count as empty; null metadata is a value of its own. Null and repeated keys stay."""
    narrow = df.select(
        df[key].alias("doc_id"), held_out(df[key]).alias("held_out"), df["text"], df["source"], df["lang"], df["n_chars"].cast("long").alias("n_chars")
    )
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        score = sent.value.score

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [score(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

        return work

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return per_batch(narrow, make, f"doc_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", key)


def classify_quality(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Co-train on the rows that aren't held out, score all."""
    return score_quality(df, fit_quality(*training_rows(df, labels)))
