"""The pipeline, stage by stage, against what each stage promises."""

import corpus_pipeline as P
import pytest

from stratum.llm import jaccard, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        f(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs)
    return out


def test_columns_and_order(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixture", "packing"]
    assert all(s.columns == want for s in stages[:-1])


def test_stages_take_effect(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in toxicity.toxic_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages[:4]]
    assert ids[0] == {r.doc_id for r in docs.select("doc_id").collect()} - rejected
    assert jaccard.near_classes(stages[1]).where("links > 0").count() == 0 and ids[1] < ids[0]
    texts = {r.doc_id: (r.text or "").split() for r in stages[2].collect()}
    seen = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(d)
    # cutting joins what stood apart, so a handful of new windows may be alike; the passages themselves are gone
    assert sum(len(x) > 1 for x in seen.values()) <= 5
    per = {}
    for r in stages[3].collect():
        per[r.source] = per.get(r.source, 0) + len((r.text or "").split())
    assert len(set(per.values())) == 1
    assert stages[4].groupBy().sum("n_tokens").first()[0] == sum(per.values())


def test_run_gives_the_same(spark, stages):
    a = sorted(map(tuple, P.run(spark, SF).collect()))
    assert a == sorted(map(tuple, stages[4].collect()))
