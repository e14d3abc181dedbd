"""The pipeline against its stages' brute-force versions, and with awkward rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from motionframe.llm import catalog, quality_rules
from tests.llm.test_llm_operators import brute_components, near, prose


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    base = prose(90)
    texts = [prose(60) for _ in range(40)] + [base, base, near(base, 1)] + [" ".join(w + "###" for w in prose(50).split()) for _ in range(20)] + [None, "", "short"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, prose(70))]
    d = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": [None] * len(rows), "n_chars": pa.array([None] * len(rows), pa.int64())}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(63), pa.int64()), "quality": pa.array([int(i < 43) for i in range(63)], pa.int32()), "toxic": pa.array([0] * 63, pa.int32())}), d / "labels.parquet")
    return str(d), rows


def test_stages(spark, sf):
    path, rows = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, path)
        assert docs.columns == before.columns, name
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(before), quality_rules.STRUCTURE).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        docs = docs.persist()
    left = [r.doc_id for r in docs.collect()]
    want, _ = brute_components([(i, t) for i, t in rows[:43]], 5, 80)
    assert sorted(i for i in left if i is not None) == sorted(set(want.values())) and None in left


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf[0]).collect()
    assert {r.doc_id for r in out} >= set(range(41)) - {41} and all(r.offset + r.length <= 2048 for r in out)


def test_classifier_drops_what_passes_the_rules(spark, sf):
    path, rows = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    passed = corpus_pipeline.rules(spark, docs, path)
    bad = set(range(43, 63))
    assert bad <= {r.doc_id for r in passed.collect()}
    left = {r.doc_id for r in corpus_pipeline.classifier(spark, passed, path).collect()}
    assert not bad & left and set(range(43)) <= left


def test_empty_tables(spark, sf, tmp_path):
    for name, table in (("documents", pq.read_table(f"{sf[0]}/documents.parquet")), ("labels", pq.read_table(f"{sf[0]}/labels.parquet"))):
        (tmp_path / "none").mkdir(exist_ok=True)
        (tmp_path / "unlabelled").mkdir(exist_ok=True)
        pq.write_table(table.slice(0, 0), tmp_path / "none" / f"{name}.parquet")
        pq.write_table(table.slice(0, 0 if name == "labels" else None), tmp_path / "unlabelled" / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/unlabelled/documents.parquet")
    passed = corpus_pipeline.rules(spark, docs, str(tmp_path / "unlabelled"))
    assert corpus_pipeline.classifier(spark, passed, str(tmp_path / "unlabelled")).count() == passed.count()


def test_every_operator_is_registered():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in catalog.QUERIES) == 1
