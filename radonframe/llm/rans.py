"""Static range asymmetric numeral systems over integer symbols, interleaved over lanes, in numpy.

State of a lane: 64 bits in [2**31, 2**63); output in 32-bit words; frequencies sum to 2**20. Symbol number k of a block
belongs to lane k modulo the number of lanes, so one step of all lanes is one vector operation. A block keeps a checkpoint,
the states and the place in its words, every ``EVERY`` steps: decoding can start at each of them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
EVERY = 256
_HEAD = struct.Struct("<IIIII")  # symbols, lanes, checkpoints, words, CRC-32 of the symbols as 32-bit integers


class Table:
    """Symbols in ascending order with frequencies that sum to 2**SCALE, each at least 1."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray) -> None:
        self.symbols, self.freqs = symbols.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freqs)[:-1]]).astype(np.uint64)
        self._of = np.zeros(int(self.symbols[-1]) + 1, np.int64)
        self._of[self.symbols] = np.arange(len(self.symbols))
        self._slots: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        symbols = np.flatnonzero(counts)
        if len(symbols) > 1 << SCALE:
            raise ValueError("more symbols than the frequency scale holds")
        c = counts[symbols].astype(np.float64)
        freqs = 1 + np.floor(c * (((1 << SCALE) - len(symbols)) / c.sum())).astype(np.int64)
        freqs[np.argmax(c)] += (1 << SCALE) - freqs.sum()
        return cls(symbols, freqs)

    def to_bytes(self) -> bytes:
        return zlib.compress(np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), "<u4")
        n = len(both) // 2
        return cls(np.cumsum(both[:n]), both[n:])

    def index(self, ids: np.ndarray) -> np.ndarray:
        return self._of[ids]

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freqs.astype(np.int64))
        return self._slots


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One independent block of at least one symbol."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    at = table.index(ids)
    freqs, starts = table.freqs[at], table.starts[at]
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[np.ndarray, int]] = []
    total, shift = 0, np.uint64(63 - SCALE)
    for step in range((n - 1) // lanes, -1, -1):
        f, s = freqs[step * lanes : (step + 1) * lanes], starts[step * lanes : (step + 1) * lanes]
        y = x[: len(f)]
        over = y >= (f << shift)
        if out := np.count_nonzero(over):
            words.append(y[over].astype(np.uint32))
            total += out
            y = np.where(over, y >> np.uint64(32), y)
        q = y // f
        x[: len(f)] = (q << np.uint64(SCALE)) + (y - q * f) + s
        if step % every == 0:
            marks.append((x.copy(), total))
    marks.reverse()
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    states = np.concatenate([m[0] for m in marks]).astype("<u8").tobytes()
    places = np.array([total - m[1] for m in marks], "<u4").tobytes()
    head = _HEAD.pack(n, lanes, len(marks), total, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + struct.pack("<I", every) + states + places + stream.astype("<u4").tobytes()


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The symbols of a block, or of its checkpoints first to last (exclusive); the checksum is verified on a whole block."""
    n, lanes, count, total, crc = _HEAD.unpack_from(block)
    (every,) = struct.unpack_from("<I", block, _HEAD.size)
    at = _HEAD.size + 4
    states = np.frombuffer(block, "<u8", count * lanes, at).reshape(count, lanes)
    places = np.frombuffer(block, "<u4", count, at + states.nbytes)
    words = np.frombuffer(block, "<u4", total, at + states.nbytes + places.nbytes)
    last = count if last is None else last
    begin, end = first * every * lanes, min(n, last * every * lanes)
    out = np.empty(end - begin, np.int32)
    slots, mask = table.slots(), np.uint64((1 << SCALE) - 1)
    x, pos = states[first].astype(np.uint64), int(places[first])
    for k in range(begin, end, lanes):
        y = x[: min(lanes, end - k)]
        slot = y & mask
        s = slots[slot]
        out[k - begin : k - begin + len(s)] = s
        y = table.freqs[s] * (y >> np.uint64(SCALE)) + slot - table.starts[s]
        need = np.flatnonzero(y < LOW)
        y[need] = (y[need] << np.uint64(32)) | words[pos : pos + len(need)]
        pos += len(need)
        x[: len(s)] = y
    ids = table.symbols[out]
    if len(ids) == n and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum does not fit its symbols")
    return ids
