import hashlib

import public_tokenizers as P
from helpers import odd_docs

import corpus_pipeline as pipeline
from domspark.llm import bpe, decontaminate, jaccard, quality, secrets


def test_stages_compose(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, sf).collect()}
    kept = {r.doc_id for r in quality.op2_quality_rules(docs).where("kept").collect()}
    good = docs.where(docs.doc_id.isin(*kept))
    first = {r.component_id for r in jaccard.near_duplicates(good).collect()}
    one = good.where(good.doc_id.isin(*first))
    dirty = {r.doc_id for r in decontaminate.contaminated(one, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = set()
    for r in one.collect():
        if r.doc_id not in dirty:
            text = secrets.redacted(r.text, secrets.all_spans(r.text, secrets.base_spans(r.text)), "[secret]")
            ids = t.encode(text, add_special_tokens=False).ids
            want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want and 50 < len(got) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = odd_docs(spark)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert bpe.encode_documents(docs, P.path("byte_bpe_50k.json")).count() == docs.count()
