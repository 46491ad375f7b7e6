import corpus_pipeline
from tideline.llm import bpe, decontaminate, jaccard, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and after.keys() <= before.keys()
        seen.append((name, before, after))
    (_, b1, a1), (_, b2, a2), (_, b3, a3), (_, b4, a4) = seen
    frame = lambda rows: spark.createDataFrame(list(rows.values()), docs.schema)
    classes = jaccard.near_copies(frame(b2), 5, 80).collect()
    assert set(a2) == {r.doc_id for r in classes if r.doc_id == r.component_id} and len(a2) == len({r.component_id for r in classes})
    hit = decontaminate.hits(frame(b3), spark.read.parquet(f"{SF}/benchmark.parquet"), keep=("doc_id",)).collect()
    assert set(a3) == {r.doc_id for r in hit if not r.contaminated}
    assert set(a4) == set(b4)
    for r in secrets.scan(frame(b4), keep=("doc_id",)).collect():
        assert (b4[r.doc_id].text == a4[r.doc_id].text) == (not r.spans) and a4[r.doc_id].n_chars == len(a4[r.doc_id].text)
    assert 0 < len(a1) < len(b1)
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    codec = bpe.Codec(bpe.vocabulary())
    assert all(codec.decode(last[i].ids) == a4[i].text for i in a4)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.ids_sha256) for r in whole} == {(r.doc_id, r.ids_sha256) for r in last.values()}
    assert quality.THRESHOLD == 0.3


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_last_stage_decodes(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.bpe_encoding(spark, docs, SF).collect()}
    assert got == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
