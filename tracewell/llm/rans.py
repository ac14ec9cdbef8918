"""Static range asymmetric numeral system over token ids, in interleaved lanes.

One table of frequencies (sum 2**bits) is shared by all blocks.  A block is cut
into rows of ``LANES`` ids; lane j codes the ids of column j with a 64-bit state
of its own, and all lanes share one stream of 32-bit words.  Every
``CHECK_ROWS`` rows the states and the place in the stream are kept, so that a
block can be decoded from several places at once; a CRC-32 of the ids ends it.

Block layout (little-endian): magic "RTB1", number of ids (4 bytes), lanes (4),
checkpoints (4), words (4), crc32 of the ids as 32-bit integers (4); then for
every checkpoint its row (4), its place (4) and one state per lane (8 each); then
the words.  The first checkpoint is row 0.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 1024
BLOCK = 1 << 18
CHECK_ROWS = 128
LOW = np.uint64(1 << 31)
MAGIC = 0x31425452


class Table:
    """Frequencies scaled to sum 2**bits, at least 1 for every id that occurs."""

    def __init__(self, counts: np.ndarray) -> None:
        self.bits = max(16, int(max(2, len(counts)) - 1).bit_length() + 4)
        counts = np.asarray(counts, np.int64)
        total, size = int(counts.sum()), 1 << self.bits
        freq = np.zeros(len(counts), np.int64)
        seen = counts > 0
        if total:
            freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * (size / total)).astype(np.int64))
            over = int(freq.sum()) - size
            order = np.argsort(-freq, kind="stable")
            if over < 0:
                freq[order[0]] -= over
            for s in order:  # the most frequent give what the rare ones were rounded up by
                if over <= 0:
                    break
                give = min(over, int(freq[s]) - 1, max(1, int(freq[s]) // 8))
                freq[s] -= give
                over -= give
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n))
    rows = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    shift, high = np.uint64(table.bits), np.uint64(63 - table.bits)
    words, marks, written = [], [], 0
    for r in range(rows - 1, -1, -1):
        s = ids[r * lanes : (r + 1) * lanes]
        x, f, c = state[: len(s)], table.freq[s], table.start[s]
        full = x >= (f << high)
        out = x[full].astype(np.uint32)
        words.append(out)
        written += len(out)
        x[full] >>= np.uint64(32)
        q = x // f
        x[:] = (q << shift) + (x - q * f) + c
        if r % CHECK_ROWS == 0:
            marks.append((r, written, state.copy()))
    marks = marks[::-1] or [(0, 0, state)]
    head = np.array([MAGIC, n, lanes, len(marks), written, zlib.crc32(ids.astype("<u4").tobytes())], "<u4").tobytes()
    points = b"".join(np.array([r, written - w], "<u4").tobytes() + x.astype("<u8").tobytes() for r, w, x in marks)
    return head + points + b"".join(w.astype("<u4").tobytes() for w in reversed(words))


def decode_from(block: bytes, table: Table, point: int = 0) -> tuple[int, np.ndarray]:
    """The ids from checkpoint ``point`` up to the next one, and the index of the first."""
    magic, n, lanes, points, _, _ = np.frombuffer(block, "<u4", 6).astype(np.int64).tolist()
    if magic != MAGIC:
        raise ValueError("not a token block")
    size = 8 + 8 * lanes
    at = 24 + point * size
    row, place = np.frombuffer(block, "<u4", 2, at).astype(np.int64).tolist()
    end = -(-n // lanes) if point + 1 == points else int(np.frombuffer(block, "<u4", 1, at + size)[0])
    state = np.frombuffer(block, "<u8", lanes, at + 8).astype(np.uint64)
    words = np.frombuffer(block, "<u4", -1, 24 + points * size)
    shift, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = np.empty(max(0, min(n, end * lanes) - row * lanes), np.uint32)
    first = row * lanes
    for r in range(row, end):
        k = min(lanes, n - r * lanes)
        x = state[:k]
        slot = x & mask
        s = table.slots[slot.astype(np.int64)]
        out[r * lanes - first : r * lanes - first + k] = s
        x[:] = table.freq[s] * (x >> shift) + slot - table.start[s]
        low = x < LOW
        m = int(np.count_nonzero(low))
        x[low] = (x[low] << np.uint64(32)) | words[place : place + m].astype(np.uint64)
        place += m
    return first, out


def decode_block(block: bytes, table: Table) -> np.ndarray:
    """All ids of a block; ValueError if they don't match the checksum."""
    points, crc = np.frombuffer(block, "<u4", 6).astype(np.int64).tolist()[3::2]
    ids = np.concatenate([decode_from(block, table, k)[1] for k in range(points)])
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a token block doesn't match")
    return ids
