import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from radonframe.llm import chat, exact_dedup, warc


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


CHATS = [
    (1, 1, "user", "hi"), (1, 2, "assistant", "### User: \\ </turn>\n</turn>\\"), (2, 1, "assistant", None), (3, None, None, "x"), (3, 1, "odd: ### role", "y"), (4, 1, "user", "a"), (4, 1, "user", "a"),
    (4, 1, "assistant", "\\\\/turn> <\\/turn> ### @6F: #\\## @"), (None, 1, "user", "w" * 200_000), (5, 1, "system", "s"), (5, 2, "user", "u"), (5, 3, "assistant", "call"), (5, 4, "tool", "t"), (5, 5, "assistant", ""),
]


def test_chats_read_back_exactly(spark):
    df = spark.createDataFrame([(*r, "t") for r in CHATS], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    texts = {r["conv_id"]: r["formatted"] for r in out.collect()}
    by = defaultdict(list)
    for c, t, role, text in sorted(CHATS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns)) and got[c]["n_turns"] == len(turns)
        assert got[c]["loss_sha256"] == sha(said) and got[c]["loss_chars"] == len(said)
        assert texts[c].count("</turn>") == len(turns) and got[c]["formatted_chars"] == len(texts[c])
    assert {c for c, r in got.items() if r["valid"]} == {1, 5}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_templates_that_cannot_be_undone_are_refused():
    with pytest.raises(ValueError):
        chat.ChatTemplate(end="\\end\n")
    with pytest.raises(ValueError):
        chat.ChatTemplate(end="ab### ")


def test_exact_duplicates(odd, none):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    got = sorted((str(r["doc_id"]), r["text_sha256"], str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(odd, salts=3).collect())
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    assert got == sorted((str(d), sha(t), str(keep[t]), len(groups[t]), d == keep[t]) for d, t in rows)
    assert exact_dedup.exact_duplicates(none).count() == 0


PAGES = [(1, "http://a/ü b\r\n", "x" * 999), (2, "http://b", "x" * 1000), (3, None, "x" * 1000), (4, "c", None), (5, "d", "é" * 500), (None, "e", "é" * 500), (6, "f", "é" * 500), (6, "f", "é" * 500), (7, "g", "<p>" + "long " * 500_000)]


@pytest.mark.parametrize("split", [997, 8 << 20])
def test_archives_read_back(spark, split):
    pages = spark.createDataFrame([(*r, "k") for r in PAGES], "page_id long, url string, html string, keep string").coalesce(1)
    manifest = warc.write_warc(pages, file_bytes=600)
    assert manifest.count() > 1
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in warc.read_warc(manifest, split).collect())
    largest = {}
    for d, _, h in PAGES:
        largest[h or ""] = max(largest.get(h or "", d), d, key=lambda v: (v is not None, v or 0))
    want = []
    for d, _, h in PAGES:
        h = h or ""
        again = len(h.encode()) >= 1000 and d != largest[h]
        want.append((str(d), len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if again else "response", str(largest[h]) if again else "None"))
    assert got == sorted(want)
    whole = warc.read_warc(manifest).filter("record_type = 'response'").select(F.decode("payload", "UTF-8").alias("p"), "payload_bytes").collect()
    assert all(len(r["p"].encode()) == r["payload_bytes"] for r in whole)
    empty = warc.write_warc(pages.limit(0))
    assert empty.count() == 0 and warc.read_warc(empty).count() == 0


def test_false_gzip_magic_is_passed_over(tmp_path):
    real = warc._member(warc.record(1, "u", b"p" * 10))
    import gzip

    (tmp_path / "f").write_bytes(b"\x1f\x8b\x08junk" + gzip.compress(b"not a record") + real)
    with open(tmp_path / "f", "rb") as f:
        assert [h["Page-ID"] for h, _ in warc.records(f, 10**6, 0, 10**6)] == ["1"]
