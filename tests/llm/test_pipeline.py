"""Each stage of the pipeline against brute force on its own input."""

from hashlib import sha256

import corpus_pipeline
from test_documents import hit_row, windows
from test_pairs import fingerprint, linked
from turnloom.llm import quality, secret_scan


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, docs, sf).cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in quality.score(docs).collect() if r.kept}
    two = stages["near_duplicates"](spark, one, sf).cache()
    rows = sorted(one.collect(), key=lambda r: r.doc_id)
    tops = linked([fingerprint(r.text) for r in rows])
    assert two.columns == docs.columns and sorted(map(tuple, two.collect())) == sorted(tuple(rows[t]) for t in set(tops))
    three = stages["decontamination"](spark, two, sf).cache()
    found = windows([(str(r.item_id), r.text) for r in bench.collect()])
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect() if not hit_row(0, r.text, found)[5]}
    four = stages["secrets"](spark, three, sf).cache()
    model = secret_scan.default_model()
    text = {r.doc_id: r.text for r in four.collect()}
    for r in three.collect():
        bad = [f[:2] for f in secret_scan.judge(model, r.text, r.source) if f[3] >= 0.5]
        assert text[r.doc_id] == secret_scan.masked(r.text, bad)
    last = stages["encoding"](spark, four, sf).collect()
    assert len(last) == len(text) and all(r.decoded_sha256 == sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.input_ids) for r in last)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(text)
