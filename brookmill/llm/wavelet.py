"""A wavelet matrix over token ids: succinct bit-planes with rank and select.

Plane k holds bit k of every id, from the highest down; before each next plane the ids are dealt
stably, those with a 0 first. One compressed file holds the planes and where the documents lie.
"""

import struct

import numpy as np
import zstandard

MAGIC = b"BWM1"
_HEAD = struct.Struct("<4sqqq")
#: Bits for each entry of the rank directory.
BLOCK = 512


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> "WaveletMatrix":
        n = len(ids)
        levels = max(1, int(ids.max()).bit_length()) if n else 1
        ids = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for shift in range(levels - 1, -1, -1):
            bit = (ids >> ids.dtype.type(shift) & ids.dtype.type(1)).astype(bool)
            padded = np.zeros(-(-max(n, 1) // BLOCK) * BLOCK, dtype=bool)
            padded[:n] = bit
            planes.append(np.packbits(padded, bitorder="little").view("<u8"))
            zeros.append(n - int(bit.sum()))
            ids = np.concatenate([ids[~bit], ids[bit]])
        return cls(planes, zeros, n)

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k].view(np.uint8), bitorder="little", count=self.n).astype(bool)

    def _directory(self) -> list[np.ndarray]:
        """Of each plane how many ones stand before each block."""
        if self._ranks is None:
            self._ranks = [np.append(0, np.cumsum(np.bitwise_count(p).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64))) for p in self.planes]
        return self._ranks

    def _rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many ones plane k has before each place."""
        self._directory()
        at = np.asarray(at, dtype=np.int64)
        block, plane = at // BLOCK, self.planes[k]
        word = at // 64
        out = self._ranks[k][block]
        for j in range(BLOCK // 64):
            w = block * (BLOCK // 64) + j
            inside = w < word
            out = out + np.where(inside, np.bitwise_count(plane[np.minimum(w, len(plane) - 1)]), 0)
        rest = (at % 64).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return out + np.bitwise_count(plane[np.minimum(word, len(plane) - 1)] & mask)

    def all(self) -> np.ndarray:
        """Every id, in order."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = self._bits(k)
            above = np.empty_like(out)
            above[~bit] = out[: self.zeros[k]]
            above[bit] = out[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k))
            out = above
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(len(self.planes)):
            ones = self._rank(k, at)
            bit = self.planes[k][at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
            out = out << 1 | bit.astype(np.int64)
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, symbol: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, stop = (np.asarray(x, dtype=np.int64) for x in (start, stop))
        if symbol < 0 or symbol >> len(self.planes):
            return start * 0, stop * 0
        for k in range(len(self.planes)):
            a, b = self._rank(k, start), self._rank(k, stop)
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            start, stop = (self.zeros[k] + a, self.zeros[k] + b) if bit else (start - a, stop - b)
        return start, stop

    def counts(self, symbol: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How often the id occurs at places from each start to before its stop."""
        a, b = self._range(symbol, start, stop)
        return b - a

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        """How often the id occurs at places from start to before stop."""
        return int(self.counts(symbol, [start], [self.n if stop is None else stop])[0])

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0) ones, or zeros, of plane k: by its rank directory, then within words."""
        ranks = self._directory()[k]
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = np.searchsorted(before, nth, side="right") - 1
        rest, plane = nth - before[block], self.planes[k] if bit else ~self.planes[k]
        word = block * (BLOCK // 64)
        for _ in range(BLOCK // 64 - 1):
            held = np.bitwise_count(plane[word]).astype(np.int64)
            ahead = rest >= held
            # once a word holds the one that is sought, its place stays
            rest, word = np.where(ahead, rest - held, rest), np.where(ahead, word + 1, word)
            if not ahead.any():
                break
        place, value = np.zeros(len(nth), dtype=np.int64), plane[word].copy()
        for width in (32, 16, 8, 4, 2, 1):
            low = value & np.uint64((1 << width) - 1)
            held = np.bitwise_count(low).astype(np.int64)
            ahead = rest >= held
            rest, place = np.where(ahead, rest - held, rest), np.where(ahead, place + width, place)
            value = np.where(ahead, value >> np.uint64(width), low)
        return word * 64 + place

    def select(self, symbol: int, nth: np.ndarray) -> np.ndarray:
        """The places of the nth occurrences (from 0) of the id."""
        (first,), (last,) = self._range(symbol, [0], [self.n])
        at = first + np.asarray(nth, dtype=np.int64)
        if len(at) and (at.min() < first or at.max() >= last):
            raise IndexError("there are not so many occurrences")
        for k in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def occurrences(self, symbol: int) -> np.ndarray:
        """All places of the id, ascending."""
        return self.select(symbol, np.arange(self.count(symbol)))


def pack(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, no_id: np.ndarray) -> bytes:
    """One file: the ids of several documents in a row, the documents' lengths and their own ids."""
    m = WaveletMatrix.of(ids)
    body = [np.asarray(m.zeros, dtype="<i8"), np.asarray(lengths, dtype="<i8"), np.asarray(doc_ids, dtype="<i8"), np.asarray(no_id, dtype=np.uint8), *m.planes]
    return _HEAD.pack(MAGIC, m.n, len(lengths), len(m.planes)) + zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in body))


def unpack(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, and for each document its length, its id, and whether it had none."""
    magic, n, docs, levels = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet file")
    raw, at = zstandard.ZstdDecompressor().decompress(data[_HEAD.size :]), 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    zeros, lengths, doc_ids, no_id = take("<i8", levels), take("<i8", docs), take("<i8", docs), take("u1", docs)
    words = -(-max(n, 1) // BLOCK) * (BLOCK // 64)
    planes = [take("<u8", words) for _ in range(levels)]
    return WaveletMatrix(planes, zeros.tolist(), n), lengths, doc_ids, no_id.astype(bool)
