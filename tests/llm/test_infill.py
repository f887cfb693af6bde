import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from radonframe.llm import infill


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n, share in ((0, 0.5), (1, 1), (63, 0.1), (64, 0.9), (65, 0.5), (512, 1), (513, 0), (9000, 0.02), (20_000, 0.97)):
        bits = rng.random(n) < share
        b = infill.Bits(bits)
        assert (b.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (b.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()


def check(docs):
    got = infill.infill(docs).withColumn("restored", infill.restored(F.col("form"), F.col("output"))).collect()
    rows = docs.select("doc_id", "text").collect()
    key = lambda x: tuple(map(repr, x))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=key) == sorted(((d, *brute(d, t), t or "") for d, t in rows), key=key)


def test_equals_brute_force(documents, odd, none):
    for docs in (documents, odd, none):
        check(docs)


def test_markers_and_their_parts(spark):
    texts = ["a <P> b", "x<S>", "<M>", "<", "<P", "P>", "<<S", "a<S b <M c <P", "é<𝄞\U0001f600 ab\ncd\x00e", "<" * 50, "", None, "́x", "ab12 <p> <s>"]
    rows = [(k * 7 + i, t) for k in range(40) for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_slices_do_not_matter(documents, monkeypatch):
    batch = documents.select("doc_id", "text").toArrow().combine_chunks().to_batches()
    whole = [r for b in infill._run(iter(batch)) for r in b.to_pylist()]
    monkeypatch.setattr(infill, "SLICE_BYTES", 1)
    assert [r for b in infill._run(iter(batch)) for r in b.to_pylist()] == whole
