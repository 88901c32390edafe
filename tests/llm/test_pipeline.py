"""The pipeline, stage by stage, against plain versions of each decision."""

from collections import Counter

import corpus_pipeline
from inversia.llm import toxicity
from inversia.llm.workspace import held_out_id
from tests.llm.messy import FOLDER, empty, messy
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_nearcopies import plain_classes


def test_stages_have_the_given_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]


def test_every_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            score = toxicity.fit_toxicity(toxicity.training_rows(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)).scorer()
            # fits may differ in the last digits of a sum
            assert {r.doc_id for r in after} ^ {r.doc_id for r in before if score(r.text) < 0.5} <= {r.doc_id for r in before if abs(score(r.text) - 0.5) < 1e-6}
        elif name == "simhash":
            first = sorted(before, key=lambda r: r.doc_id)  # of each class the smallest id stays
            labels, _ = plain_classes([r.text for r in first])
            assert sorted(r.doc_id for r in after) == sorted({first[i].doc_id for i in labels}) and len(after) < len(before)
        elif name == "decontamination":
            leaks = {x[0] for x in plain_leaks([(r.doc_id, r.text) for r in before], benchmark)}
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in leaks) and leaks
        elif name == "mixing":
            copies = Counter(map(tuple, after))
            assert set(copies) <= set(map(tuple, before)) and max(copies.values()) <= 3 and len(set(copies.values())) > 1
        else:
            assert docs.columns == [*columns, "shard", "slot"] and len(after) == len(before)
            sizes = Counter(r.shard for r in after)
            assert max(sizes.values()) - min(sizes.values()) <= 1


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 50 and out.columns[-2:] == ["shard", "slot"]


def test_odd_and_empty_documents(spark, tmp_path):
    for k, make in enumerate((messy, empty)):
        docs = make(spark)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{i}")
        assert (docs.count() > 0) == (k == 0)


def test_toxic_documents_are_removed(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1")
    toxic = {r.doc_id for r in labels.collect() if not held_out_id(r.doc_id)}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.remove_toxic(spark, docs, FOLDER).collect()}
    assert toxic and not toxic & kept
