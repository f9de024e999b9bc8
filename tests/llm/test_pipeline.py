"""The pipeline's stages on the smallest tables and on awkward ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeplan.llm import decontaminate, jaccard, registry, secrets, toxicity
from ridgeplan.runtime import load

from .test_operators import awkward, table


def test_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        before, after = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in out.collect())
        assert not after - before
        kept.append(sum(after.values()))
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontaminate", "secrets", "packing"]
    assert kept[0] < 200 and kept[1] < kept[0] and kept[2] < kept[1] and kept[3] == kept[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed.collect())


def test_stage_rules(spark, sf_dir):
    """Each stage's decision agrees with its operator's results."""
    docs, labels, benchmark = (load(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    model = toxicity.train(docs, labels)
    low = {r.doc_id for r in toxicity.score_documents(docs, model).filter("score < 0.3").collect()}
    assert {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, sf_dir).collect()} == low
    groups = jaccard.JaccardJoin(5, 80, 100).components(docs)
    assert {r.doc_id for r in corpus_pipeline.jaccard_stage(spark, docs, sf_dir).collect()} == {r.component_id for r in groups.collect()}
    clean = {r.doc_id for r in decontaminate.contamination(docs, benchmark).filter("n_hit = 0").collect()}
    assert {r.doc_id for r in corpus_pipeline.decontaminate_stage(spark, docs, sf_dir).collect()} == clean
    left = secrets.secret_spans(corpus_pipeline.secrets_stage(spark, docs, sf_dir))
    assert left.filter(F.size("spans") > 0).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_awkward_tables(spark, sf_dir, stage):
    docs = table(spark, awkward())
    out = stage(spark, docs, sf_dir)
    assert out.count() > 0
    assert stage(spark, docs.filter("false"), sf_dir).count() == 0


def test_repeated_ids_stay_together(spark, sf_dir):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "a b c d e f g h"), (3, None), (3, None)]
    out = corpus_pipeline.jaccard_stage(spark, table(spark, rows), sf_dir)
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 1, None, 3, 3])


def test_registry():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
