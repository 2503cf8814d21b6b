import numpy as np

import corpus_pipeline
from factloom.llm import secrets, simhash, toxicity
from tests.llm.test_documents import check_packing


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = [r for r, s in zip(rows, model.scores(r["text"] for r in rows), strict=True) if s < toxicity.THRESHOLD]
    prints = np.array([simhash.fingerprint((r["text"] or "").encode()) for r in kept], np.uint64)
    group = list(range(len(kept)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, j in zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3), strict=True):
        group[root(i)] = root(j)
    least = {}
    for k, r in enumerate(kept):
        least[root(k)] = min(least.get(root(k), r["doc_id"]), r["doc_id"])
    kept = [r for r in kept if r["doc_id"] in set(least.values())]
    clean = {r["doc_id"]: secrets.redact(r["text"], secrets.scan(r["text"])[1]) for r in kept}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(clean)
    check_packing(got, clean)


def test_stages_with_repeated_and_null_ids(spark, sf_dir):
    """Rows that share an id or have none go through every stage as rows of their own."""
    a, b = "a quiet walk along the river in the early morning light", "token: 0123456789abcdefghij stands in this note of another kind"
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [{"doc_id": i, "text": t} for i, t in ((1, a), (1, a), (1, b), (None, b), (None, None), (2, None))]
    docs = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, sf_dir).count() == 6
    kept = stages["simhash_near_dedup"](spark, docs, sf_dir)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (2, None)], key=repr)
    clean = stages["secret_scan"](spark, kept, sf_dir)
    assert sorted(str(r.text) for r in clean.collect()) == sorted([a, "[SECRET] stands in this note of another kind", "None"])
    assert sorted((r.doc_id, r.piece) for r in stages["best_fit_packing"](spark, clean, sf_dir).collect()) == [(1, 0), (1, 0), (2, 0)]


def test_stages_keep_columns_and_take_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf_dir).columns == docs.columns, name
        assert stage(spark, empty, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
