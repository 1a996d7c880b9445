"""Packing: documents' ids laid into sequences of at most `capacity` tokens with little padding.

Best-fit decreasing. A document over the capacity is first cut into full windows. The rest, longest
first, each goes to the open window with the least room that is enough for it; a segment tree over
the rooms 0 to capacity, which tells below which node any window is open, finds that room in
as many steps as the capacity has bits. Windows left with more than `slack` tokens of room are laid
end to end and cut anew into full ones, and the last rest into powers of two, so padding is at
most slack a sequence whatever the lengths are; with slack=None nothing that fits is ever cut.

Every task packs what it reads, in shards of about `shard_tokens` ids, so no text is shuffled, and no
document, source or group of copies gathers anywhere. Order within a shard is settled by
length, id and the ids' crc32, so a task run again gives the same pieces.

Nulls and edges: a null or empty text holds its end id alone; a null doc_id stays null; repeated
rows are packed each; one very long text is encoded whole; an empty table gives no rows; other columns are
left out.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokenfiles import encode_texts

CAPACITY, END, SHARD_TOKENS = 4096, 2, 8_000_000
#: Tokens of room that a sequence may keep.
SLACK = 32


class Rooms:
    """Open windows by the room they have, under a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)  # how many windows below each node
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, n: int) -> None:
        node = self.size + room
        while node:
            self.open[node] += n
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """The least room of at least `need` and a window that has it, which is taken out."""
        node = self.size + need
        while not self.open[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node + (not self.open[2 * node])
        room = node - self.size
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each length, all at most capacity, in the order given; and how many windows."""
    rooms, window, offset, n = Rooms(capacity), [], [], 0
    for length in lengths:
        found = rooms.tightest(length)
        if found is None:
            found, n = (capacity, n), n + 1
        room, at = found
        window.append(at)
        offset.append(capacity - room)
        if room > length:
            rooms.put(room - length, at)
    return window, offset, n


def _powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def lay(lengths: list[int], capacity: int = CAPACITY, slack: int | None = SLACK) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of the pieces of items of these lengths, given longest first."""
    pieces, rests, n = [], [], 0
    for item, length in enumerate(lengths):
        whole = length // capacity
        pieces += [(item, k * capacity, capacity, n + k, 0) for k in range(whole)]
        n += whole
        if length > whole * capacity:
            rests.append((length - whole * capacity, item, whole * capacity))
    rests.sort(key=lambda r: -r[0])
    window, offset, windows = best_fit([r[0] for r in rests], capacity)
    fill = [0] * windows
    for (length, _, _), w in zip(rests, window):
        fill[w] += length
    loose = [slack is not None and capacity - f > slack and f & (f - 1) != 0 for f in fill]
    number = {w: n + k for k, w in enumerate(w for w in range(windows) if not loose[w])}
    n += len(number)
    again = []
    for (length, item, start), w, at in zip(rests, window, offset):
        if loose[w]:
            again.append((w, at, item, start, length))
        else:
            pieces.append((item, start, length, number[w], at))
    total = sum(x[4] for x in again)
    sizes = [capacity] * (total // capacity) + _powers(total % capacity)
    room, used = iter(sizes), 0
    left = next(room, 0)
    for _, _, item, start, length in sorted(again):
        while length:
            part = min(length, left)
            pieces.append((item, start, part, n, used))
            start, length, used, left = start + part, length - part, used + part, left - part
            if not left:
                n, used, left = n + 1, 0, next(room, 0)
    return pieces


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, slack: int | None = SLACK, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids of every piece.

    path: the tokenizer's file, at the same place on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), 0, []

        def shard() -> pa.RecordBatch:
            nonlocal first
            ids, sizes, doc_ids, no_id = (np.concatenate(x) for x in zip(*held))
            held.clear()
            ids, begin = ids.astype("<u4"), np.cumsum(sizes) - sizes
            raw = memoryview(ids).cast("B")
            crc = lambda a, n: zlib.crc32(raw[4 * a : 4 * (a + n)])
            whole = np.fromiter((crc(a, n) for a, n in zip(begin.tolist(), sizes.tolist())), dtype=np.int64, count=len(sizes))
            order = np.lexsort((whole, doc_ids, no_id, -sizes))
            item, start, length, sequence, offset = np.array(lay(sizes[order].tolist(), capacity, slack), dtype=np.int64).T
            item = order[item]
            at = begin[item] + start
            made = [
                pa.array(doc_ids[item], pa.int64(), mask=no_id[item]),
                pa.array(start),
                pa.array(length),
                pa.array([crc(a, n) for a, n in zip(at.tolist(), length.tolist())], pa.int64()),
                pa.array(sizes[item]),
                pa.array((part << 32) + first + sequence),
                pa.array(offset),
            ]
            if with_ids:
                ends = np.cumsum(length)
                place = np.repeat(at - (ends - length), length) + np.arange(int(ends[-1]))
                made.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids[place].astype(np.int32))))
            first += int(sequence.max()) + 1
            return pa.RecordBatch.from_arrays(made, columns)

        tokens = 0
        for piece in slices(batches):
            column = piece.column("doc_id")
            ids, sizes = encode_texts(piece.column("text"), path, end)
            held.append((ids, sizes, column.fill_null(0).to_numpy(), ~column.is_valid().to_numpy(zero_copy_only=False)))
            tokens += len(ids)
            if tokens >= shard_tokens:
                yield shard()
                tokens = 0
        if held:
            yield shard()

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in columns))


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids (padded to capacity, except at a power of two) and docs (doc_id, offset, length in order) of pieces with ids.

    A sequence has at most capacity tokens, so its group is bounded.
    """
    own = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("own"), F.sum("length").alias("n_tokens"))
    full = F.expr("(n_tokens & (n_tokens - 1)) = 0")
    padding = F.when(full, F.lit(0)).otherwise(capacity - F.col("n_tokens")).cast("int")
    ids = F.concat(F.flatten(F.col("own.ids")), F.array_repeat(F.lit(pad).cast("int"), padding))
    return own.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("own", lambda x: F.struct(x.doc_id, x.offset, x.length)).alias("docs"))
