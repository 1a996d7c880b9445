"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text gets a space in front; spaces are the piece `▁`. It is cut into units, where no piece of
the vocabulary reaches over a cut: before a space that follows something else, and around line
breaks. Within a unit an agenda of adjacent pairs is worked off: the pair whose merger has the
best score goes first, the leftmost of equals; a candidate (the two spans it would join) is
skipped for good if its keyed hash falls under `dropout`. The key holds the seed, the unit, the
spans, the document's id and the unit's place. So a unit is segmented differently from place to
place, yet the same in every run. Units are worked off side by side, very long ones one by one with
a heap. With dropout 0 equal units are worked off once, and the ids are those of the sentencepiece
library.

What no piece covers becomes byte pieces, and so does a literal `▁`, so decoding gives back every
text exactly.

Nulls and edges: a null text counts as empty and gets no ids; empty ids decode to the empty text,
null ids to null; a null id keys like the empty text; repeated rows get equal ids; whole texts
are encoded, however long. Extra columns pass through unless they carry the name of an output,
which then replaces them.
"""

import functools
import heapq
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mix64, slices

DROPOUT, SEED = 0.1, 42
#: Characters from which on a unit gets an agenda of its own.
LONG = 256
#: Bytes of text that a task encodes at once; each takes about 150 times its size in arrays.
SLICE_BYTES = 1 << 19
_UNIT = re.compile("[ ]*[^ \n▁]+|[ ]+|\n|▁")
#: The last character of a unit before a space, which starts another.
_BORDER = re.compile("[^ ](?= )")
_NONE = np.iinfo(np.int32).max


class Vocabulary(NamedTuple):
    #: Bytes that each id stands for.
    spelled: list[bytes]
    #: Id of each code point, or -1.
    single: np.ndarray
    #: Id of each byte's piece.
    of_byte: np.ndarray
    #: Ascending left * 2**32 + right, and for each the merged id and its rank (lower: earlier).
    pairs: np.ndarray
    merged: np.ndarray
    rank: np.ndarray
    #: The same by pair: rank and merged id.
    known: dict[int, tuple[int, int]]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    spelled, single, of_byte, ids = [], np.full(0x110000, -1, dtype=np.int64), np.zeros(256, dtype=np.int64), {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            of_byte[value] = i
            spelled.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i):
            spelled.append(b"")
        else:
            spelled.append(piece.replace("▁", " ").encode())
            ids[piece] = i
            if len(piece) == 1:
                single[ord(piece)] = i
    single[32], single[0x2581] = single[0x2581], -1
    rows = [(ids[p[:k]] << 32 | ids[p[k:]], i, model.get_score(i)) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    rows.sort()
    scores = np.array([-s for _, _, s in rows])
    rank = np.unique(scores, return_inverse=True)[1]
    known = dict(zip([r[0] for r in rows], zip(rank.tolist(), [r[1] for r in rows])))
    return Vocabulary(spelled, single, of_byte, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), rank, known)


def _candidates(symbol: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, other: np.ndarray, key: np.ndarray, v: Vocabulary, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of symbols, spans start to mid and mid to end, those that may merge, and their places in v.pairs."""
    at = np.flatnonzero((symbol >= 0) & (other >= 0))
    pair = symbol[at].astype(np.int64) << 32 | other[at]
    place = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
    known = v.pairs[place] == pair
    at, place = at[known], place[known]
    if limit:
        spans = (start[at].astype(np.int64) << 40 | mid[at].astype(np.int64) << 20 | end[at]).astype(np.uint64)
        stays = mix64(key[at] ^ mix64(spans)) >= limit
        at, place = at[stays], place[stays]
    return at, place


def _mix(x: int) -> int:
    """mix64 of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def merge_long(symbol: np.ndarray, key: np.uint64, v: Vocabulary, limit: np.uint64) -> np.ndarray:
    """Symbols of one unit after its agenda: the best candidate first, the leftmost of equals, by a heap."""
    n = len(symbol)
    starts = np.arange(n)
    at, place = _candidates(symbol[:-1], starts[:-1], starts[1:], starts[1:] + 1, symbol[1:], np.full(n - 1, key), v, limit)
    agenda = list(zip(v.rank[place].tolist(), at.tolist(), (at + 1).tolist(), (at + 2).tolist(), v.merged[place].tolist()))
    heapq.heapify(agenda)
    own, end, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n))
    of_unit, least = int(key), int(limit)

    def offer(start: int, mid: int) -> None:
        found = v.known.get(own[start] << 32 | own[mid]) if own[start] >= 0 and own[mid] >= 0 else None
        if found and (not least or _mix(of_unit ^ _mix((start << 40 | mid << 20 | end[mid]) % 2**64)) >= least):
            heapq.heappush(agenda, (found[0], start, mid, end[mid], found[1]))

    while agenda:
        _, start, mid, stop, into = heapq.heappop(agenda)
        if end[start] != mid or end[mid] != stop:  # a neighbour took one of the two
            continue
        own[start], end[start], end[mid] = into, stop, -1
        if stop < n:
            before[stop] = start
            offer(start, stop)
        if start:
            offer(before[start], start)
    return np.array([x for x, e in zip(own, end) if e >= 0], dtype=np.int64)


def merge(units: list[str], place_key: np.ndarray, v: Vocabulary, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units in a row, and where each one's start (and the end of the last)."""
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    key = np.fromiter((zlib.crc32(u.encode("utf-8", "surrogatepass")) for u in units), dtype=np.uint64, count=len(units))
    key = mix64(mix64(key ^ place_key) ^ mix64(np.array([seed], dtype=np.uint64)))
    limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))

    symbol = v.single[points]
    symbol = np.where(symbol < 0, -1 - points.astype(np.int64), symbol).astype(np.int32)
    unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
    start = (np.arange(len(symbol)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    size = np.ones(len(symbol), dtype=np.int32)
    done: list[tuple[np.ndarray, ...]] = []
    if len(sizes) and sizes.max() >= LONG:
        first = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes >= LONG).tolist():
            made = merge_long(symbol[first[k] : first[k] + sizes[k]], key[k], v, limit)
            done.append((np.full(len(made), k), np.arange(len(made)), made))
        rest = np.repeat(sizes < LONG, sizes)
        symbol, unit, start = symbol[rest], unit[rest], start[rest]
        size = size[: len(symbol)]
    # over the units that may still merge: their symbols, and for each symbol the pair with its right neighbour
    rank = np.full(len(symbol), _NONE, dtype=np.int32)
    into = np.zeros(len(symbol), dtype=np.int32)
    fresh = np.arange(len(symbol))
    while len(symbol):
        rank[fresh] = _NONE
        at = fresh[fresh < len(symbol) - 1]
        at = at[unit[at] == unit[at + 1]]
        hit, place = _candidates(symbol[at], start[at], start[at + 1], start[at + 1] + size[at + 1], symbol[at + 1], key[unit[at]], v, limit)
        at = at[hit]
        rank[at], into[at] = v.rank[place], v.merged[place]

        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.minimum.reduceat(rank, first)
        lengths = np.diff(np.append(first, len(symbol)))
        open_ = np.repeat(best != _NONE, lengths)
        shut = np.flatnonzero(~open_)
        done.append((unit.take(shut), start.take(shut), symbol.take(shut)))
        if not open_.any():
            break
        hit = np.flatnonzero((rank == np.repeat(best, lengths)) & open_)
        hit = hit[np.append(True, unit[hit[1:]] != unit[hit[:-1]])]  # the leftmost of each unit
        symbol[hit] = into[hit]
        size[hit] += size[hit + 1]
        keep = open_
        keep[hit + 1] = False
        moved = np.cumsum(keep) - 1
        fresh = moved[hit]
        kept = np.flatnonzero(keep)
        unit, start, symbol, size, rank, into = (x.take(kept) for x in (unit, start, symbol, size, rank, into))
        fresh = np.concatenate([fresh, fresh[fresh > 0] - 1])
    unit, start, symbol = (np.concatenate(x) if done else np.zeros(0, dtype=np.int64) for x in (zip(*done) if done else ((), (), ())))
    order = np.lexsort((start, unit))
    unit, symbol = unit[order], symbol[order]
    lost = np.flatnonzero(symbol < 0)
    if len(lost):  # characters without a piece, as bytes
        raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in symbol[lost].tolist()]
        times = np.ones(len(symbol), dtype=np.int64)
        times[lost] = [len(b) for b in raw]
        symbol, unit = np.repeat(symbol, times), np.repeat(unit, times)
        symbol[symbol < 0] = v.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    return symbol, np.searchsorted(unit, np.arange(len(units) + 1))


def _cut(text: str) -> Iterator[str]:
    """A space and the text in parts of about SLICE_BYTES characters; no part ends within a unit."""
    text, start = " " + text, 0
    while len(text) - start > SLICE_BYTES:
        border = _BORDER.search(text, start + SLICE_BYTES)
        if border is None:
            break
        yield text[start : border.start() + 1]
        start = border.start() + 1
    yield text[start:] if start else text


def encode_texts(texts: list[str | None], keys: list[str], path: str, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's start (and the end of the last)."""
    v, lengths, out = vocabulary(path), np.zeros(len(texts), dtype=np.int64), []
    units: list[str] = []
    held: list[tuple[int, int, int]] = []  # text, how many units, place of the first
    size = 0

    def flush() -> None:
        nonlocal size
        if units:
            text, counts, first = np.array(held, dtype=np.int64).T
            if dropout > 0:
                own = np.repeat(mix64(np.array([zlib.crc32(keys[t].encode()) for t in text], dtype=np.uint64) << np.uint64(32) ^ np.uint64(seed)), counts)
                place = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts - first, counts)
                ids, bounds = merge(units, mix64(own + place.astype(np.uint64)), v, dropout, seed)
            else:
                at, known = pd.factorize(np.array(units, dtype=object))
                ids, ends = merge(list(known), np.zeros(len(known), dtype=np.uint64), v, dropout, seed)
                n = np.diff(ends)[at]
                bounds = np.append(0, np.cumsum(n))
                ids = ids[np.repeat(ends[at] - bounds[:-1], n) + np.arange(bounds[-1])]
            np.add.at(lengths, text, np.diff(bounds[np.append(0, np.cumsum(counts))]))
            out.append(ids.astype(np.int32))
        units.clear()
        held.clear()
        size = 0

    for k, t in enumerate(texts):
        place = 0
        for part in _cut(t) if t else ():
            own = _UNIT.findall(part)
            units += own
            held.append((k, len(own), place))
            place, size = place + len(own), size + len(part)
            if size >= SLICE_BYTES:
                flush()
    flush()
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), np.append(0, np.cumsum(lengths))


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", verify: bool = False) -> DataFrame:
    """docs with ids, an array of int; path: the SentencePiece BPE model, at the same place on every machine.

    With verify also lossless: whether the ids, decoded again, give exactly the text.
    """
    docs = docs.drop("ids", *["lossless"] * verify)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("lossless", T.BooleanType())] * verify])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text, SLICE_BYTES):
            keys = ["" if k is None else str(k) for k in piece.column(doc_id).to_pylist()]
            flat, bounds = encode_texts(piece.column(text).to_pylist(), keys, path, dropout, seed)
            column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            made = [column]
            if verify:
                spelled = vocabulary(path).spelled
                made.append(pa.array([decode_ids(flat[a:b], spelled) == (t.as_py() or "") for t, a, b in zip(piece.column(text), bounds[:-1], bounds[1:])], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*piece.columns, *made], schema.names)

    return docs.mapInArrow(run, schema)


def decode_ids(ids: np.ndarray, spelled: list[bytes]) -> str:
    raw = b"".join([spelled[i] for i in ids.tolist()])
    return raw[1:].decode("utf-8", "surrogatepass")


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with decoded, the text that the ids stand for."""
    docs = docs.drop("decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = vocabulary(path).spelled
        for batch in batches:
            column = batch.column(ids)
            flat, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            valid = column.is_valid().to_pylist()
            texts = [decode_ids(flat[a:b], spelled) if ok else None for ok, a, b in zip(valid, bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return docs.mapInArrow(run, schema)
