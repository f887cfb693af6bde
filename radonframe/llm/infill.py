"""Fill-in-the-middle forms of texts, cut by rank and select over packed token boundaries.

1. Bitvectors: of the UTF-8 bytes of a slice of documents, one bit says that a unit (a run of ASCII letters, or any other code point) starts
   there, another that a code point does. Bits are packed into 64-bit words; a directory holds the ones before each block of 8 words.
2. Cuts: the ones between a document's ends are its number of units n. Two hashes of its id choose two numbers of units; select gives the
   bytes where those units start, rank over the other bitvector the code points before them.
3. Forms: ``plain`` is the text; ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.
   A text that has a marker stays plain, so the first occurrence of each marker in an output is the marker itself and ``restored`` is exact.

Defined cases: null and empty texts have no units and are plain; a null id hashes as an empty one; repeated rows get the same form; a slice
is as long as its longest text, whatever that is; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = ("<P>", "<S>", "<M>")
PLAIN, SPM = 90, 20  # of 100: texts from PLAIN on are plain, and of the others those below SPM suffix first
SLICE_BYTES = 1 << 22
_WORDS = 8  # of 64 bits in a block of the directory
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Bits:
    """A packed bitvector with a directory of the ones before each block."""

    def __init__(self, bits: np.ndarray) -> None:
        size = -(-(len(bits) + 1) // (64 * _WORDS)) * _WORDS * 8  # a whole number of blocks, with room to ask for the end
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(size - len(packed), np.uint8)]).view("<u8").reshape(-1, _WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, word, bit = at // (64 * _WORDS), at // 64 % _WORDS, (at % 64).astype(np.uint64)
        mine = self.words[block]
        whole = np.where(np.arange(_WORDS) < word[:, None], np.bitwise_count(mine), 0).sum(axis=1, dtype=np.int64)
        part = np.bitwise_count(mine[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.before[block] + whole + part

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the one that has k ones before it; k below their number."""
        block = np.searchsorted(self.before, k, side="right") - 1
        sums = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        left = k - self.before[block]
        word = (sums <= left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, sums[np.arange(len(k)), np.maximum(word - 1, 0)], 0)
        bits = np.unpackbits(np.ascontiguousarray(self.words[block, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * 64 * _WORDS + word * 64 + (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Where units and code points start in the joined bytes of texts that begin at ``starts``."""
    first = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[1:] & letter[:-1]
    inside[starts[starts < len(data)]] = False
    return Bits(first & ~inside), Bits(first)


def hashes(doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex SHA-256 of ``1:`` and the id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def _forms(ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, texts)])
    units, points = boundaries(np.frombuffer(b"".join(texts), np.uint8), ends[:-1])
    before = units.rank(ends)
    n = np.diff(before)
    h = np.array([hashes(x) for x in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = np.repeat(ends[1:, None], 2, axis=1)
    row, side = np.nonzero(cuts < n[:, None])
    at[row, side] = units.select(before[row] + cuts[row, side])
    chars = points.rank(np.concatenate([ends[:-1], at[:, 0], at[:, 1]])).reshape(3, -1)
    forms, outputs = [], []
    for k, text in enumerate(texts):
        a, b = at[k] - ends[k]
        if not text or h[k, 2] % 100 >= PLAIN or any(m.encode() in text for m in MARKERS):
            forms.append("plain")
            outputs.append(text)
        elif h[k, 3] % 100 < SPM:
            forms.append("spm")
            outputs.append(b"".join((b"<S>", text[b:], b"<P>", text[:a], b"<M>", text[a:b])))
        else:
            forms.append("psm")
            outputs.append(b"".join((b"<P>", text[:a], b"<S>", text[b:], b"<M>", text[a:b])))
    plain = np.array([f == "plain" for f in forms], bool)
    sizes = [pa.array(x, pa.int64(), mask=plain) for x in np.diff(chars, axis=0)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *sizes, pa.array(outputs, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, held = [], [], 0
        for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(d)
            texts.append((text.as_py() or "").encode())
            held += len(texts[-1])
            if held >= SLICE_BYTES:
                yield _forms(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield _forms(ids, texts)


def infill(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per document; the two numbers of code points are null where the form is plain."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run, FORMS)


def restored(form: Column, output: Column) -> Column:
    """The text, from an output and its form alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, "<M>", 1)
        return one, two, F.substring(rest, F.length(two) + 4, F.length(rest))

    prefix, suffix, middle = parts("<P>", "<S>")
    after, before, between = parts("<S>", "<P>")
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, between, after)).otherwise(output)
