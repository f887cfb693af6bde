import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from radonframe.llm import rans, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
T = Tokenizer.from_file(PATH)


def ids(text):
    return np.array([*T.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_the_library():
    rng = random.Random(0)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "Word", " don't", "'s", "'LL", "12", "é", "日本", "\u00a0", "\u2028", "\u3000", "\x1c", "\x85", "\u200b", "\x00", "!?", "_", "<|endoftext|>", "<|endof", "\U0001f600", "e\u0301", "ſ", "İ", "\ufeff", "\u180e", "²", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, " " * 5000, "x \n" * 2000]
    encode = token_files.Encoder(PATH)
    for text, data in zip(texts, encode(texts), strict=True):
        assert data == np.array(T.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_encoder_equals_the_library_next_to_any_character():
    """Every character of the first plane, and each 17th beyond, next to letters, digits, signs, white space and itself. Checked with version 0.23.3 of the library."""
    encode = token_files.Encoder(PATH)
    points = [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 17)]
    for lo in range(0, len(points), 4000):
        texts = [f"a{c}b {c}1{c} '{c}s\n{c}{c} .{c}  {c}" for c in map(chr, points[lo : lo + 4000])]
        want = T.encode_batch(texts, add_special_tokens=False)
        for text, data, w in zip(texts, encode(texts), want, strict=True):
            assert data == np.array(w.ids, "<u4").tobytes(), repr(text)


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  World", "", "a\nb"]
    assert token_files.Encoder(path)(texts) == [np.array(Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("tokens,block", [(token_files.FILE_TOKENS, token_files.BLOCK_TOKENS), (5000, 700)])
def test_files_read_back(documents, odd, tokens, block):
    for docs in (documents, odd):
        manifest = token_files.write_tokens(docs, PATH, file_tokens=tokens, block_tokens=block)
        got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digests(manifest).orderBy("start").collect()]
        want, at = [], 0
        for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
            x = ids(r["text"])
            want.append((r["doc_id"], at, len(x), zlib.crc32(x.tobytes())))
            at += len(x)
        assert got == want


def test_empty_table(none):
    manifest = token_files.write_tokens(none, PATH)
    assert manifest.count() == 0 and token_files.token_digests(manifest).count() == 0


def test_ids_of_documents(spark):
    docs = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in token_files.read_pieces(token_files.write_tokens(docs, PATH), with_ids=True).collect()}
    assert got == {1: ids("hello there").tolist(), 2: [0]}


@pytest.mark.parametrize("n", [1, 2, 63, 1000, 200_000])
def test_coder(n):
    rng = np.random.default_rng(n)
    data = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(data))
    block = rans.encode(data, table, lanes=64, every=16)
    again = rans.Table.from_bytes(table.to_bytes())
    assert (rans.decode(block, again) == data).all()
    every = 16 * max(1, min(64, n // 64))
    for k in range(0, -(-n // every), 7):
        assert (rans.decode(block, again, k, k + 1) == data[k * every : (k + 1) * every]).all()


def test_a_changed_block_is_noticed():
    data = np.arange(1000, dtype=np.uint32) % 50
    table = rans.Table.of_counts(np.bincount(data))
    block = bytearray(rans.encode(data, table))
    block[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(block), table)


def test_crc_of_joined_parts():
    a, b = b"some bytes", b"and many more" * 99
    assert token_files.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_a_million_empty_texts(spark):
    docs = spark.range(1_000_000, numPartitions=1).selectExpr("id AS doc_id", "cast(null AS string) AS text")
    began = time.time()
    got = token_files.token_digests(token_files.write_tokens(docs, PATH))
    row = got.selectExpr("count(*)", "sum(n_tokens)", "max(start)", "count(distinct ids_crc32)").first()
    assert tuple(row) == (1_000_000, 1_000_000, 999_999, 1)
    assert time.time() - began < 60


def test_recurring_parts_are_encoded_once(monkeypatch):
    """New words with a comma after them: the model is asked for each word, and for the comma once."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, asked = token_files.Encoder(path), []
    model = encode.tokenize
    monkeypatch.setattr(encode, "tokenize", lambda x: asked.append(x) or model(x))
    text = " ".join("".join(chr(97 + k // 26**i % 26) for i in range(4)) + "," for k in range(1000))
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert asked.count(",") == 1 and len(asked) == 1001
