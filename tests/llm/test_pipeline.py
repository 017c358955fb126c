"""The whole pipeline against brute force: only the toxicity model itself is taken as it is."""

import zlib

import numpy as np
import public_tokenizers
from test_dedup import expected_components, marks
from tokenizers import Tokenizer

import corpus_pipeline
from prismcube.llm import toxicity


def test_pipeline_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
    clean = docs.where(~docs.doc_id.isin(*toxic)) if toxic else docs
    first = {i for i, _, _, kept in expected_components(clean) if kept}
    left = sorted((r.doc_id, r.text.encode()) for r in clean.collect() if r.doc_id in first)
    texts = {i: bytes(np.frombuffer(s, np.uint8)[~hit]).decode("utf-8", "ignore") for i, s, hit in marks(left, 50)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    at: dict = {}
    for r in sorted(corpus_pipeline.run(spark, small).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in ids.items()}
    assert 0 < len(left) < docs.count()
