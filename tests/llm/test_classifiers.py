"""Language, toxicity and quality: held-out accuracy and defined results for odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inversia.llm import language, linear, ngrams, quality, toxicity
from inversia.llm.workspace import LONG_ROWS, few_at_once, held_out, held_out_id, read_table
from tests.llm.messy import empty, messy

FOLDER = "/root/testdata/sf0.01"


def test_held_out_fold(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(-20, 200), None]], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("out"))
    for r in rows.collect():
        assert r.out == held_out_id(r.doc_id) == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_blocks_lose_no_ngram(monkeypatch):
    text = "the quick brown fox " * 30
    whole = set(ngrams.hashed(ngrams.code_points(text), (2, 4), 20).tolist())
    monkeypatch.setattr(ngrams, "BLOCK", 64)
    parts = {x for p in ngrams.blocks(text, 4) for x in ngrams.hashed(p, (2, 4), 20).tolist()}
    assert parts == whole


def test_language_on_held_out_rows(spark):
    df = read_table(spark, FOLDER, "documents")
    got = language.identify_language(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0.0 <= r.score <= 1.0 for r in got)


def test_language_learns_from_the_other_folds_only(spark):
    df = read_table(spark, FOLDER, "documents")
    changed = df.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language.identify_language(x).collect())) for x in (df, changed))
    assert a == b


def test_language_of_odd_rows(spark):
    df = messy(spark)
    texts = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
    got = language.identify_language(df).collect()
    assert len(got) == df.count() and {r.lang_pred for r in got} <= {"en", "de", "und"}
    undetermined = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {d for d, t in texts if t is None or not any(map(str.isalpha, t))} <= undetermined
    assert language.identify_language(empty(spark)).collect() == []
    assert {r.lang_pred for r in language.predict_language(df, language.fit_language(empty(spark))).collect()} == {"und"}


@pytest.fixture(scope="module")
def tables(spark):
    return read_table(spark, FOLDER, "documents"), read_table(spark, FOLDER, "labels")


WORDS = "idiot|clown|pathetic|worthless|moron|disgusting|trash|stupid|scum|loser"


def test_toxicity_on_held_out_rows(spark):
    # more rows to learn from than the smallest table has
    df, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(toxicity.training_rows(df, labels))
    scored = toxicity.score_toxicity(df, model).where("held_out")
    rows = scored.join(labels, "doc_id", "left").join(df.select("doc_id", F.lower("text").rlike(WORDS).alias("has")), "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1 and r.has]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_never_reads_labels_to_score(tables):
    df, labels = tables
    model = toxicity.fit_toxicity(toxicity.training_rows(df, labels))
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit_toxicity(toxicity.training_rows(df, flipped))
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score_toxicity(df, m).collect()) for m in (model, again))
    assert a == b


def test_toxicity_of_odd_rows(spark, tables):
    df, labels = tables
    model = toxicity.fit_toxicity(toxicity.training_rows(df, labels))
    odd = messy(spark)
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0.0 <= r.score <= 1.0 for r in got)
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    kept = toxicity.drop_toxic(odd, model).count()
    assert kept == sum(r.predicted == 0 for r in got)
    assert toxicity.score_toxicity(empty(spark), model).collect() == []


def test_toxicity_without_or_with_one_class(spark):
    odd, none = messy(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(toxicity.training_rows(odd, none))
    assert {r.predicted for r in toxicity.score_toxicity(odd, model).collect()} == {0}
    one = spark.createDataFrame([(i, None, 0) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(toxicity.training_rows(odd, one))
    assert {r.predicted for r in toxicity.score_toxicity(odd, model).collect()} == {0}


def plain_buckets(text, lengths, bits):
    """The bucket of each n-gram, one by one, in whole numbers."""
    mask = (1 << 64) - 1
    points = [32 if ord(c) < 128 and not "a" <= c <= "z" else ord(c) for c in text.lower()]
    out = []
    for n in lengths:
        for i in range(len(points) - n + 1):
            h = 0
            for p in points[i : i + n]:
                h = (h * 0x100000001B3 + p + 1) & mask
            out.append((((h + n) & mask) * 0x9E3779B97F4A7C15 & mask) >> (64 - bits))
    return out


def test_naive_bayes_by_hand(spark):
    rows = [("abc de", "x"), ("abc f", "x"), ("de fé", "y"), ("zz", "z"), ("", "z"), (None, "x"), ("q", None)]
    bits, smoothing = 12, language.SMOOTHING
    models = language.fit_language(spark.createDataFrame(rows, "text string, lang string"), bits=bits)
    known = [(t, c) for t, c in rows if t is not None and c is not None]
    for probe in ("abc", "de zz", "é"):
        logs = {}
        for c in "xyz":
            counts = np.zeros(1 << bits)
            for t, own in known:
                for k in plain_buckets(t, (1, 2, 3), bits) if own == c else ():
                    counts[k] += 1
            p = np.log((counts + smoothing) / (counts + smoothing).sum())
            logs[c] = np.log(sum(own == c for _, own in known) / len(known)) + sum(p[k] for k in plain_buckets(probe, (1, 2, 3), bits))
        got = dict(zip(models[0].languages, models[0].scores([probe])[0]))
        assert got.keys() == logs.keys() and all(abs(got[c] - logs[c]) < 1e-4 for c in logs)


def test_language_in_several_matrices(spark):
    """600 languages, each with a letter pair of its own: none is left out, and the cut into matrices doesn't show."""
    rows = []
    for i in range(600):
        word = chr(0x4E00 + i) * 2 + chr(0x6000 + i)
        rows += [(f"l{i:03d}", f"{word} {word}"), (f"l{i:03d}", word)]
    df = spark.createDataFrame([(n, t, c) for n, (c, t) in enumerate(rows)], "doc_id long, text string, lang string")
    one, three = (language.fit_language(df, at_once=k, bits=14) for k in (600, 250))
    assert [len(m.languages) for m in three] == [250, 250, 100]
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language.predict_language(df, m).collect()} for m in (one, three))
    assert a == b
    want = dict(enumerate(c for c, _ in rows))
    assert np.mean([a[i][0] == want[i] for i in want]) > 0.98 and {x for x, _ in a.values()} >= {f"l{i:03d}" for i in range(500, 590)} - {want[i] for i in want if a[i][0] != want[i]}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        language.fit_language(spark.createDataFrame([("a", c) for c in "pqrs"], "text string, lang string"))


def test_log_ratios():
    counts = np.array([[0.0, 50.0, 100.0], [10.0, 5.0, 10.0]])
    ratios = toxicity.log_ratios(counts)
    for j in range(3):
        shares = [(counts[k][j] + 1) / sum(counts[k] + 1) for k in (0, 1)]
        assert abs(ratios[j] - np.log(shares[1] / shares[0])) < 1e-12
    sized = toxicity.log_ratios(counts.copy(), (100, 10))
    assert abs(sized[1] - np.log((6 / 12) / (51 / 102))) < 1e-12


def test_sparse_fit_against_a_plain_solver(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(120):
        i = np.sort(rng.choice(6, 3, replace=False))
        v = rng.normal(size=3)
        rows.append((float(rng.random() < 1 / (1 + np.exp(-(v.sum() + (0 in i))))), float(rng.integers(1, 4)), i.tolist(), v.tolist()))
    table = spark.createDataFrame(rows, "label double, weight double, i array<int>, v array<double>")
    scale, l2 = np.array([1.0, 2.0, 0.5, 1.0, 3.0, 1.0]), 0.05
    for valued in (True, False):
        weights, intercept = linear.fit_sparse(table if valued else table.drop("v"), scale, l2, iterations=200)
        x = np.zeros((len(rows), 6))
        for r, (_, _, i, v) in enumerate(rows):
            x[r, i] = scale[i] * (v if valued else 1.0)
        y, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        p = 1 / (1 + np.exp(-(x @ weights + intercept)))
        # at the least loss its gradient is zero
        assert np.abs((w * (p - y)) @ x / w.sum() + l2 * weights).max() < 1e-4 and abs((w * (p - y)).sum() / w.sum()) < 1e-4


def test_quality_bounds_rows_of_a_hot_key(spark):
    rows = [(7 if i % 2 else i, f"text number {i}", "s", "en", 12) for i in range(6_000)] + [(None, f"no id {i}", "s", "en", 9) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6_000)] + [(7, 1)] * 3, "doc_id long, quality int")
    known, pool = quality.training_rows(docs, labels, most=1_000)
    n = known.count()
    assert 850 < n < 1_150 and known.where("doc_id = 7").count() > 350
    assert pool.count() == 50 and pool.where("doc_id is null").count() == 50
    again, _ = quality.training_rows(docs, labels, most=10**9)
    assert again.count() == sum(not held_out_id(r[0]) for r in rows[:6_000])


def test_quality_on_held_out_rows(tables):
    df, labels = tables
    known, pool = quality.training_rows(df, labels)
    model = quality.fit_quality(known, pool)
    assert {r["from"] for r in model.rounds} == {"text", "metadata"} and any(r["rows"] for r in model.rounds)
    rows = quality.score_quality(df, model).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.85


def test_quality_of_odd_rows(spark, tables):
    df, labels = tables
    odd = messy(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify_quality(odd, none).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.5}
    few = spark.createDataFrame([(i * 3 + 1, i % 2, None) for i in range(20)] + [(None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify_quality(odd, few).collect()
    assert len(got) == odd.count() and all(0.0 <= r.score <= 1.0 for r in got)
    assert quality.classify_quality(empty(spark), labels).collect() == []


def test_platt_recovers_a_slope():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * x - 1)))).astype(float)
    slope, offset = quality.platt(x, y)
    assert abs(slope - 0.5) < 0.08 and abs(offset + 1) < 0.15


def test_toxicity_learns_from_few_rows(spark):
    # 58 clean and 10 toxic rows to learn from: no n-gram stands out by any fixed test
    df, labels = (read_table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(toxicity.training_rows(df, labels))
    learned = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect() if not held_out_id(r.doc_id)}
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, model).collect() if r.doc_id in learned}
    assert sum(learned.values()) >= 10 and got == learned


def test_toxicity_counts_rare_terms(spark):
    # 2 of 2,400 rows hold the term: far fewer than any cut by strength leaves
    rows = [(i, f"plain words of row {i % 30} and more", 0) for i in range(2_000)]
    rows += [(i, "you are a loser, plain words", 1) for i in range(2_000, 2_398)] + [(i, "zzqxjv", 1) for i in (2_398, 2_399)]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    score = model.scorer()
    assert score("plain words and zzqxjv") > score("plain words and more") and score("zzqxjv") > 0.5


def test_toxicity_fits_on_a_bounded_share_of_each_class(spark):
    texts = spark.createDataFrame([(f"t{i}", float(i < 300), i) for i in range(20_000)], "text string, label double, key long")
    rows = toxicity.fitted_rows(texts, {0.0: 19_700, 1.0: 300}, 2_000).groupBy("label").agg({"*": "count", "weight": "sum"}).collect()
    got = {r["label"]: (r["count(1)"], r["sum(weight)"]) for r in rows}
    assert got[1.0] == (300, 300.0) and abs(got[0.0][0] - 1_700) < 200 and abs(got[0.0][1] / 19_700 - 1) < 0.12


def test_quality_pool_is_every_unlabelled_row(spark):
    n = 12_000
    docs = spark.range(n).selectExpr("id as doc_id", "'a text' as text", "'s' as source", "'en' as lang", "6 as n_chars")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(i, None) for i in range(100, 150)], "doc_id long, quality int")
    pool = {r.doc_id for r in quality.training_rows(docs, labels)[1].select("doc_id").collect()}
    assert pool == {i for i in range(100, n) if not held_out_id(i)}


def test_quality_pseudo_labels_count_repeated_rows_once(spark):
    rows = [(i, f"good {i} prose here" if i % 2 else "xx xx xx", "s1" if i % 2 else "s2", "en", 20, float(i % 2)) for i in range(200)]
    known = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, label double")
    unlabelled = known.drop("label").withColumn("doc_id", F.col("doc_id") + 1_000)
    model = quality.fit_quality(known, unlabelled.union(unlabelled).union(unlabelled))
    once = quality.fit_quality(known, unlabelled)
    assert model.rounds == once.rounds and sum(r["rows"] for r in model.rounds) > 0
    assert np.allclose(model.text.weights, once.text.weights, atol=1e-3)


def test_a_fit_opens_few_long_rows_at_once(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 2), 1.0, [i % 7, 7]) for i in range(600)], "label double, weight double, i array<int>").coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, collect = spark.conf.get(size), [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: (seen.append(int(spark.conf.get(size))), collect(df))[1])
    linear.fit_sparse(rows, np.ones(8), 0.1, iterations=2)
    assert seen and max(seen) <= LONG_ROWS
    monkeypatch.undo()

    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    with few_at_once(spark):
        found = [r["n"] for r in rows.mapInArrow(lengths, "n long").collect()]
    assert sum(found) == 600 and max(found) <= LONG_ROWS
    with pytest.raises(ZeroDivisionError), few_at_once(spark):
        1 / 0
    assert spark.conf.get(size) == before


def test_the_driver_gets_one_vector_for_each_step_of_a_fit(spark):
    size, tasks, rng = 1 << 15, 4, np.random.default_rng(3)
    rows = [(float(i % 2), 1.0, list(range(size)), rng.normal(size=size).tolist()) for i in range(tasks)]
    table = spark.createDataFrame(rows, "label double, weight double, i array<int>, v array<double>").repartition(tasks).localCheckpoint()
    context = spark.sparkContext
    context.setJobGroup("steps", "")
    try:
        linear.fit_sparse(table, rng.random(size), 1e-3, iterations=1)
        jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("steps")]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sent = sorted(context._jsc.sc().statusStore().lastStageAttempt(s).resultSize() for j in jobs for s in j.stageIds if context.statusTracker().getStageInfo(s))
    assert sent and sent[-1] < 1.5 * 8 * size
