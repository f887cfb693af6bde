import zlib

import public_tokenizers
from test_decontaminate import brute
from tokenizers import Tokenizer

import corpus_pipeline
from radonframe.llm import mixing, quality


def test_stages(spark, sf_dir, documents):
    labels, docs = spark.read.parquet(f"{sf_dir}/labels.parquet"), documents
    out = {}
    for name, step in corpus_pipeline.STAGES:
        df = step(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == documents.columns
            df = spark.createDataFrame(df.collect(), documents.schema)
        out[name] = df
        docs = df
    ids = lambda df: [r["doc_id"] for r in df.collect()]
    first, second, third, mixed, tokens = out.values()
    good = [r["doc_id"] for r in quality.score_documents(documents, labels).filter("predicted = 1").collect()]
    assert sorted(ids(first)) == sorted(good) and 0 < len(good) < documents.count()
    assert set(ids(second)) <= set(good)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = [b[-1] for b in brute([(r["doc_id"], r["text"]) for r in second.collect()], items)]
    assert sorted(ids(third)) == sorted(d for d, h in zip(ids(second), hit, strict=True) if not h)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(third).collect()}
    assert sorted(ids(mixed)) == sorted(d for d, n in copies.items() for _ in range(n))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for r in sorted(mixed.collect(), key=lambda r: (r["doc_id"], r["text"])):
        x = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], at, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))))
        at += len(x)
    assert sorted(map(tuple, tokens.collect())) == sorted(want)


def test_empty_documents(spark, sf_dir, none, documents):
    docs = documents.limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf_dir)
    assert docs.count() == 0
