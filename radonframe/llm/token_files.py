"""Token files: documents as token ids in ascending id order, compressed by a static range asymmetric numeral system.

Writing: documents are dealt by ranges of id (a sampled range partitioning) and sorted within each; each task encodes
its documents and writes one file per ``FILE_TOKENS`` tokens. A file has one frequency table, shared by its
blocks; every block of ``BLOCK_TOKENS`` tokens is interleaved over lanes, has checkpoints and a checksum, and decodes
on its own. A document may go on in the next block or file. Files get unique names, and a task's file names reach
the manifest, a table, only when the task succeeds: a repeated task leaves files that nothing reads.

File: magic | table | document index | blocks | index (JSON) | index offset, length, CRC-32 | magic.

Reading: one row per block of the manifest; tasks read byte ranges and decode. Offsets of files are a running sum over the
manifest, which has one row per file.

Defined cases: null text counts as empty (just the end id); null ids come first; equal ids follow each other in the order
of their texts; an empty table writes no file; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rans
from .storage import new_folder, open_fs, stage

MAGIC = b"RFTOKEN1"
FILE_TOKENS = 1 << 22
BLOCK_TOKENS = 1 << 20
CACHE_PIECES = 600_000
CACHE_PARTS = 1 << 16
BLOCKS_PER_TASK = 8
MANIFEST = "part int, seq int, file string, n_tokens long, blocks array<struct<block:int,first:long,n:long,at:long,bytes:long>>"
_TAIL = struct.Struct("<QII")
_PIECE = re.compile(r"\s*\S+|\s+")
_RUN = re.compile(r"\s[ \n]")
# How byte-level tokenizers split a text, and the characters that stand for bytes in their vocabularies
# (printable Latin-1 characters for themselves, the other bytes in order from U+0100).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(_OTHERS)}
_SPACE = chr(_BYTE_CHARS[0x20])


class _Pieces(dict):
    """Ids by piece, those of the last generation moving up when seen again; new ones are learned."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn, self.old = learn, {}

    def __missing__(self, key: str) -> bytes:
        data = self.old.get(key)
        if data is None:
            data = self.learn(key)
        self[key] = data
        return data


class Encoder:
    """Texts to ids as little-endian 32-bit bytes, by a tokenizers file.

    A byte-level tokenizer never joins a non-space with white space after it, so a text's ids are those of its pieces
    (white space and the word after it). Pieces recur: a cache keeps those seen since about ``CACHE_PIECES`` new ones ago. A new piece
    is split as the tokenizer does and each part goes through its model; parts such as punctuation recur in new pieces and have a cache of their own. Pieces with an added token in them, and tokenizers of
    other kinds, take the library's whole encoding. Keys of the cache: a word for a space and the word, a line feed and a word for
    just that, a space and any other piece for that piece.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind["pre_tokenizer"] or {}
        self.added = [t["content"] for t in kind["added_tokens"]]
        self.cuts = kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cuts = self.cuts and all(re.fullmatch(r"\S+", t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in kind["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces = _Pieces(self._learn)
        self.part = lru_cache(CACHE_PARTS)(self._part)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        # of printable ASCII, only the space has another character
        chars = part.replace(" ", _SPACE) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.tokenize(chars)]).tobytes()

    def _learn(self, key: str) -> bytes:
        if key.isalpha():
            return self._part(f" {key}")
        piece = key[1:] if key[:1] == " " else key if key[:1] == "\n" else f" {key}"
        for a in self.added:
            if a in piece:
                return self._whole(piece)
        parts = _SPLIT.findall(piece)
        if len(parts) == 1:
            return self._part(piece)
        # a part that is a space and a word is a piece of its own
        return b"".join([self.pieces[p[1:]] if p[0] == " " and p[1:].isalpha() else self.part(p) for p in parts])

    def _keys(self, text: str) -> list[str]:
        if _RUN.search(text):  # some run of white space has two characters
            return [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else p if p[0] == "\n" and len(p) > 1 and not p[1].isspace() else f" {p}" for p in _PIECE.findall(text)]
        out: list[str] = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = f"\n{words[0]}" if out else f" {words[0]}"
            out += words
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [self._whole(x) for x in texts]
        if len(self.pieces) > CACHE_PIECES:
            fresh = _Pieces(self._learn)
            fresh.old, self.pieces = dict(self.pieces), fresh
        get = self.pieces.__getitem__
        return [b"".join(map(get, self._keys(x))) for x in texts]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def file_bytes(ids: np.ndarray, docs: list[tuple[int | None, int, int, int]], block_tokens: int = BLOCK_TOKENS) -> tuple[bytes, list[dict]]:
    """A file of ids, and its blocks. docs: (id, tokens here, tokens of the document before these, tokens of the document)."""
    table = rans.Table.of_counts(np.bincount(ids))
    parts = [MAGIC, table.to_bytes()]
    numbers = np.array([(d[0] or 0, d[0] is None, *d[1:]) for d in docs], "<i8").tobytes()
    parts.append(zlib.compress(numbers))
    sections = [[8, len(parts[1]), zlib.crc32(parts[1])], [8 + len(parts[1]), len(parts[2]), zlib.crc32(parts[2])]]
    at, blocks = sum(map(len, parts)), []
    for k in range(0, len(ids), block_tokens):
        part = ids[k : k + block_tokens]
        parts.append(rans.encode(part, table))
        blocks.append({"block": len(blocks), "first": k, "n": len(part), "at": at, "bytes": len(parts[-1])})
        at += len(parts[-1])
    index = json.dumps({"table": sections[0], "docs": sections[1], "blocks": blocks}).encode()
    return b"".join([*parts, index, _TAIL.pack(at, len(index), zlib.crc32(index)), MAGIC]), blocks


def read_index(f, size: int) -> tuple[rans.Table, np.ndarray, list[dict]]:
    """Table, document rows and blocks of an open file."""
    f.seek(size - _TAIL.size - 8)
    at, n, crc = _TAIL.unpack(f.read(_TAIL.size))
    if f.read(8) != MAGIC:
        raise ValueError("not a token file")

    def section(at: int, n: int, crc: int) -> bytes:
        f.seek(at)
        if zlib.crc32(data := f.read(n)) != crc:
            raise ValueError("a section's checksum does not fit")
        return data

    index = json.loads(section(at, n, crc))
    docs = np.frombuffer(zlib.decompress(section(*index["docs"])), "<i8").reshape(-1, 5)
    return rans.Table.from_bytes(section(*index["table"])), docs, index["blocks"]


def _writer(path: str, folder: str, end_id: int, file_tokens: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part, rows, held, docs, n = TaskContext.get().partitionId(), [], [], deque(), 0

        def flush(whole: bool) -> None:
            nonlocal held, n
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            while len(ids) >= file_tokens or (whole and len(ids)):
                now, here, left = ids[:file_tokens], [], min(len(ids), file_tokens)
                while left:
                    d, m, before, total = docs.popleft()
                    here.append((d, min(m, left), before, total))
                    if m > left:
                        docs.appendleft((d, m - left, before + left, total))
                    left -= here[-1][1]
                data, blocks = file_bytes(now, here, block_tokens)
                name = f"{folder}/{part:06d}-{len(rows):05d}-{uuid.uuid4().hex}.rft"
                fs, where = open_fs(name)
                fs.create_dir(where.rsplit("/", 1)[0])
                with fs.open_output_stream(where, compression=None) as f:
                    f.write(data)
                rows.append({"part": part, "seq": len(rows), "file": name, "n_tokens": len(now), "blocks": blocks})
                ids = ids[file_tokens:]
            held, n = [ids], len(ids)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                few = batch.slice(k, 256)
                for d, data in zip(few.column(0).to_pylist(), encode([x or "" for x in few.column(1).to_pylist()]), strict=True):
                    ids = np.frombuffer(data + end, "<u4")
                    held.append(ids)
                    docs.append((d, len(ids), 0, len(ids)))
                    n += len(ids)
                    if n >= file_tokens:
                        flush(False)
        flush(True)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_tokens", pa.int64()), ("blocks", pa.list_(pa.struct([("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64())])))]))

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, file_tokens: int = FILE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the files; the manifest (part, seq, file, n_tokens, blocks) comes back as a staged table."""
    folder = new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # a hot id's rows can go to several ranges, in order of their texts
    dealt = rows.repartitionByRange("doc_id", F.substring("text", 1, 64), F.xxhash64("text")).sortWithinPartitions("doc_id", F.substring("text", 1, 64), F.xxhash64("text"))
    return stage(dealt.mapInArrow(_writer(tokenizer_path, folder, end_id, file_tokens, block_tokens), MANIFEST), "tokens-manifest")


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file: tuple = ("",)
        for batch in batches:
            for row in batch.to_pylist():
                if open_file[0] != row["file"]:
                    fs, where = open_fs(row["file"])
                    f = fs.open_input_file(where)
                    table, docs, blocks = read_index(f, f.size())
                    ends = np.cumsum(docs[:, 2])
                    open_file = (row["file"], f, table, docs, blocks, ends)
                _, f, table, docs, blocks, ends = open_file
                block = blocks[row["block"]]
                f.seek(block["at"])
                ids = rans.decode(f.read(block["bytes"]), table).astype("<u4")
                lo, hi = block["first"], block["first"] + block["n"]
                a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "total", "at", "n", "crc", "ids")}
                for d, m, end in zip(docs[a:b].tolist(), docs[a:b, 2].tolist(), ends[a:b].tolist(), strict=True):
                    first, last = max(lo, end - m), min(hi, end)
                    data = ids[first - lo : last - lo]
                    before = d[3] + first - (end - m)  # tokens of the document before these
                    for k, v in (("doc_id", None if d[1] else d[0]), ("start", row["base"] + first - before), ("total", d[4]), ("at", before), ("n", last - first), ("crc", zlib.crc32(data.tobytes())), ("ids", data if with_ids else None)):
                        out[k].append(v)
                types = [pa.int64()] * 6 + [pa.list_(pa.uint32()) if with_ids else pa.null()]
                arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
                if with_ids:
                    arrays[6] = arrays[6].cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays[: 6 + with_ids], list(out)[: 6 + with_ids])

    return run


def read_pieces(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, total, at, n, crc[, ids]): the part of each document in each block, decoded from the files."""
    # parts first: what one task puts in order is a row for each task of the writer, and its files by themselves
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.sum("n").over(upto.orderBy("part")).alias("before"))
    within = F.sum("n_tokens").over(upto.partitionBy("part").orderBy("seq"))
    based = manifest.join(parts, "part").withColumn("base", F.coalesce("before", F.lit(0)) + F.coalesce(within, F.lit(0)))
    units = based.select("file", "base", F.explode("blocks.block").alias("block"))
    kind = "doc_id long, start long, total long, at long, n long, crc long" + ", ids array<long>" * with_ids
    count = based.agg(F.sum(F.size("blocks")).alias("n")).first()["n"] or 0
    return units.repartition(max(1, -(-count // BLOCKS_PER_TASK)), "file", "block").mapInArrow(_reader(with_ids), kind)


def crc32_combine(a: int, b: int, n: int) -> int:
    """CRC-32 of two strings after each other, from that of each and the second's length in bytes."""

    def times(m: list[int], v: int) -> int:
        s, k = 0, 0
        while v:
            s ^= m[k] if v & 1 else 0
            v, k = v >> 1, k + 1
        return s

    shift = [0xEDB88320, *[1 << k for k in range(31)]]  # one zero bit
    for _ in range(3):
        shift = [times(shift, x) for x in shift]  # one zero byte
    while n:
        if n & 1:
            a = times(shift, a)
        shift, n = [times(shift, x) for x in shift], n >> 1
    return a ^ b


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crcs = []
        for pieces in b.column("pieces").to_pylist():
            crc = pieces[0]["crc"]
            for p in pieces[1:]:
                crc = crc32_combine(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("total"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files."""
    pieces = F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces")
    docs = read_pieces(manifest).groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("total").alias("total"), pieces)
    whole = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["n"]) == F.col("total")
    return docs.withColumn("total", F.when(whole, F.col("total")).otherwise(F.raise_error(F.lit("tokens of a document are missing")))).mapInArrow(
        _joined, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
