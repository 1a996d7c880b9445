"""SimHash fingerprints, their links by BK-trees, and near-duplicate removal.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles. Two
fingerprints link at `radius` differing bits or fewer. Distinct fingerprints are dealt to shards
by the value of each of their blocks; every shard is a BK-tree, searched by its own members.
With radius + 1 blocks two fingerprints within the radius share a block, so no link is lost. A
shard of over `max_shard` fingerprints is dealt out again by blocks of its other bits, by the
same rule. A shard reports the components it found (one row for a fingerprint at most, never
all pairs), which a distributed component search joins together.

The trees travel to their queries by the shuffle and are not broadcast from the driver: trees
over the fingerprints of all documents would have to pass through it whole.

Nulls and edges: a null or empty text, or one without words, has the fingerprint zero, which
links like any other; a text with fewer words than a shingle is one shingle; repeated rows each
get their row; rows with a null doc_id take part, but name a component only (as null) where no
row of it has an id. An empty table gives no rows. Extra columns are left out of the groups and
kept by `drop_near_duplicates`.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bktree import Forest
from .common import give_back, mix64, saved, whole_rows
from .components import components

MAX_SHARD = 20_000
#: Fingerprints of whole shards that a task turns into trees at once.
PIECE = 200_000
#: Texts that share a prefix shingle and are paired in one task; rows that a task holds; pairs that it looks at at once.
MAX_BUCKET, BUCKET_ROWS, PAIRS = 2_000, 20_000, 250_000
#: Bits of a text's sketch at most; bytes of sketches that are compared at once.
MAX_SKETCH, SKETCH_BYTES = 8192, 4 << 20
#: Texts to verify whose hashes (eight bytes each) may be broadcast; those of more are joined.
BROADCAST_TEXTS = 2_000_000
#: Keys of dropped and repeated rows (two hashes each) that may be broadcast; those of more are joined.
BROADCAST_KEYS = 1_000_000
#: Shingles' frequencies are counted by so many leading bits of their hashes.
RANGE_BITS = 18


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a whole text, repeats included."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.append(0, ends[:-words] + 1)
    cut = [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, itertools.repeat(42)), dtype=np.uint64, count=len(cut))


def fingerprint(hashes: np.ndarray, bits: int = 64) -> str:
    """Hex digits of the majority bits; from the 65th on they come from the hashes mixed anew."""
    out = ""
    for k in range(bits // 64):
        h = mix64(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else hashes
        counts = np.zeros(64, dtype=np.int64)
        for start in range(0, len(h), 1 << 16):
            part = h[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * counts > len(h)).tobytes().hex()
    return out


def with_fingerprint(docs: DataFrame, words: int, bits: int, text: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingles(t, words), bits) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", of(F.col(text)))


def _dealt(prints: DataFrame, digits: int, blocks: int, left_over: int, max_shard: int) -> DataFrame:
    """shard, fingerprint: each fingerprint in the shard of each block of its hex digits.

    Shards of over max_shard rows are dealt again by `left_over` blocks of the other digits.
    """
    place = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    first = prints.select("fingerprint", place.alias("b"))
    first = first.withColumn("shard", F.concat_ws(":", "b", F.expr(f"substr(fingerprint, b * {digits} + 1, {digits})")))
    large = first.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > max_shard).select("shard", F.lit(True).alias("large"))
    other = F.expr(f"concat(substr(fingerprint, 1, b * {digits}), substr(fingerprint, b * {digits} + {digits + 1}))")
    first = first.join(large, "shard", "left").withColumn("other", F.when(F.col("large"), other))
    step = (digits * blocks - digits) // left_over
    again = F.transform(F.sequence(F.lit(0), F.lit(left_over - 1)), lambda j: F.concat_ws(":", "shard", j, F.substring("other", j * step + 1, F.lit(step))))
    return first.select("fingerprint", F.explode(F.when(F.col("large"), again).otherwise(F.array("shard"))).alias("shard"))


def _in_shards(dealt: DataFrame, search) -> DataFrame:
    """a, b: the pairs that search(forest) returns, over whole shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(frame: pd.DataFrame) -> pa.RecordBatch:
            key = frame.shard.to_numpy()
            first = np.append(True, key[1:] != key[:-1])
            shard = np.cumsum(first) - 1
            several = (np.bincount(shard) > 1)[shard]
            frame, shard = frame[several], shard[several]
            text = frame.fingerprint.to_numpy()
            values = np.frombuffer(bytes.fromhex("".join(text)), dtype=">u8").astype(np.uint64).reshape(len(text), -1) if len(text) else np.zeros((0, 1), dtype=np.uint64)
            a, b = search(Forest(values, shard)) if len(text) else (np.zeros(0, dtype=np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(text[a], pa.string()), pa.array(text[b], pa.string())], ["a", "b"])

        held: pd.DataFrame | None = None
        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(held) >= PIECE:
                whole = int(np.searchsorted(held.shard.to_numpy() == held.shard.iloc[-1], True))
                if whole:
                    yield pairs(held.iloc[:whole])
                    held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield pairs(held)
        held = None
        give_back()

    return dealt.repartition("shard").sortWithinPartitions("shard", "fingerprint").mapInArrow(run, "a string, b string")


def _spanning(radius: int):
    def search(forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        label = forest.components(radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return linked, label[linked]

    return search


def simhash_groups(docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 3, max_shard: int = MAX_SHARD) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id that is reachable over links."""
    blocks = radius + 1
    if bits % 64 or bits // 4 % blocks or (bits // 4 // blocks * (blocks - 1)) % blocks:
        raise ValueError("the hex digits of a fingerprint must deal out evenly over radius + 1 blocks, and so must the rest")
    prints = saved(with_fingerprint(docs.select("doc_id", "text"), words, bits).select("doc_id", "fingerprint"))
    distinct = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    links = _in_shards(_dealt(distinct, bits // 4 // blocks, blocks, blocks, max_shard), _spanning(radius))
    of = components(links)
    named = distinct.join(of, distinct.fingerprint == of.node, "left").select("fingerprint", "first_id", "component")
    lowest = named.where("component is not null").groupBy("component").agg(F.min("first_id").alias("lowest"))
    named = named.join(lowest, "component", "left")
    named = named.select("fingerprint", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("lowest")).alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How often shingles of each hash range occur in an eighth of the rows. It only orders shingles: the results are the same with any other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << RANGE_BITS, dtype=np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                np.add.at(seen, _range_of(np.unique(shingles(t, words))), 1)
            give_back()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(8)) == 0).select("text").mapInArrow(count, "at long, n long")
    rows = some.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << RANGE_BITS, dtype=np.int64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def _range_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RANGE_BITS)).astype(np.int64)


def prefix(distinct: np.ndarray, frequency: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest distinct shingles, so many that two sets at least `similarity` alike share one of theirs."""
    if not len(distinct):
        return np.zeros(1, dtype=np.uint64)
    order = np.lexsort((distinct, frequency[_range_of(distinct)]))
    return distinct[order[: len(distinct) - int(np.ceil(similarity * len(distinct) - 1e-9)) + 1]]


def sketch(distinct: np.ndarray) -> bytes:
    """A bit for each place of a table, set if an odd number of the shingles fall there.

    The table has twice as many places as there are shingles, to a power of two, MAX_SKETCH at most.
    Two sets differ in at least as many shingles as their sketches in bits, so few common shingles
    show without the sets at hand.
    """
    bits = min(MAX_SKETCH, max(64, 1 << int(2 * len(distinct) - 1).bit_length())) if len(distinct) else 64
    odd = np.bincount((distinct & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def apart(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the sketches (an object array of bytes) at a and b differ; the larger one is folded to the smaller."""
    size = np.fromiter(map(len, sketches), dtype=np.int64, count=len(sketches))
    small, out = np.minimum(size[a], size[b]), np.zeros(len(a), dtype=np.int64)

    def folded(at: np.ndarray, width: int) -> np.ndarray:
        rows = np.zeros((len(at), width // 8), dtype=np.uint64)
        for own in np.unique(size[at]).tolist():
            of = size[at] == own
            bits = np.frombuffer(b"".join(sketches[at[of]]), dtype=np.uint64).reshape(-1, own // width, width // 8)
            rows[of] = np.bitwise_xor.reduce(bits, axis=1)
        return rows

    for width in np.unique(small).tolist():
        pairs = np.flatnonzero(small == width)
        used, places = np.unique(np.concatenate([a[pairs], b[pairs]]), return_inverse=True)
        rows, places = folded(used, width), places.reshape(2, -1)
        step = max(1, SKETCH_BYTES // width)
        for start in range(0, len(pairs), step):
            x, y = (rows[places[side, start : start + step]] for side in (0, 1))
            out[pairs[start : start + step]] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _needed(size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """So many shingles are common to two sets of these sizes that are `similarity` alike."""
    return similarity / (1 + similarity) * (size_a.astype(np.int64) + size_b) - 1e-9


def possible(size: np.ndarray, sketches: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets at a and b can be `similarity` alike, by their sizes and sketches. No pair that is gets False."""
    out = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
    a, b = a[out], b[out]
    out[out] = (size[a].astype(np.int64) + size[b] - apart(sketches, a, b)) / 2 >= _needed(size[a], size[b], similarity)
    return out


def _possible_pairs(pairs: DataFrame, similarity: float) -> DataFrame:
    """digest_a, digest_b of the pairs (one and other: digest, size, sketch) that can be `similarity` alike."""

    @F.pandas_udf("boolean")
    def can(size_a: pd.Series, sketch_a: pd.Series, size_b: pd.Series, sketch_b: pd.Series) -> pd.Series:
        size, sketches = (np.concatenate([x.to_numpy(), y.to_numpy()]) for x, y in ((size_a, size_b), (sketch_a, sketch_b)))
        at = np.arange(len(size_a))
        return pd.Series(possible(size, sketches, at, at + len(at), similarity))

    kept = pairs.where(can("one.size", "one.sketch", "other.size", "other.sketch"))
    return kept.select(F.col("one.digest").alias("digest_a"), F.col("other.digest").alias("digest_b"))


def _with_signature(docs: DataFrame, words: int, similarity: float, propose_words: int, bits: int, text: str) -> DataFrame:
    """docs with fingerprint (of the distinct shingles), size (of the set that decides), prefix and sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequencies(docs.select("row.doc_id", "row.text"), words))

    @F.pandas_udf("fingerprint string, size int, prefix array<long>, sketch binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            own = np.unique(shingles(t, words))
            out.append((fingerprint(np.unique(shingles(t, propose_words)), bits), max(1, len(own)), prefix(own, sent.value, similarity).view(np.int64), sketch(own)))
        give_back()
        return pd.DataFrame(out, columns=["fingerprint", "size", "prefix", "sketch"])

    return docs.withColumn("_made", of(F.col(text))).select("*", "_made.*")


class _Buckets:
    """Pairs of texts that share a prefix shingle, are not joined yet and can still be alike enough.

    Rows (sig, comp, id, size, pos, side, sketch) come by sig and comp. Where the texts' first
    common shingle stands at pos, only the shingles from there on can be common; and sets differ in
    as many shingles as their sketches in bits, or more.
    """

    COLUMNS = ["sig", "comp", "id", "size", "pos", "side", "sketch"]

    def __init__(self, similarity: float):
        self.similarity = similarity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in self.COLUMNS]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) >= BUCKET_ROWS else 0
            if last:
                yield from self._run([x[:last] for x in held])
                held = [x[last:].copy() for x in held]  # a view would keep the rows before it
                give_back()
        if held is not None and len(held[0]):
            yield from self._run(held)
        held = None
        give_back()

    def _run(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, comp, id_, size, pos, side, sketches = rows
        stops = lambda fresh: np.repeat(np.append(np.flatnonzero(fresh)[1:], len(sig)), np.diff(np.append(np.flatnonzero(fresh), len(sig))))
        fresh = np.append(True, sig[1:] != sig[:-1])
        other = stops(fresh | np.append(True, comp[1:] != comp[:-1]))  # the first row of the bucket's next comp
        many = stops(fresh) - other
        cost, start = np.cumsum(many), 0
        while start < len(sig):
            stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + PAIRS, side="right")))
            n = many[start:stop]
            a = np.repeat(np.arange(start, stop), n)
            b = np.repeat(other[start:stop] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            # side -1: every two rows of the bucket meet
            a, b = (x[((side[a] < 0) | (side[a] != side[b])) & (id_[a] != id_[b])] for x in (a, b))
            likely = 1 + np.minimum(size[a] - pos[a] - 1, size[b] - pos[b] - 1) >= _needed(size[a], size[b], self.similarity)
            a, b = a[likely], b[likely]
            keep = possible(size, sketches, a, b, self.similarity)
            if keep.any():
                pairs = np.unique(np.sort(np.stack([id_[a[keep]], id_[b[keep]]], axis=1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "other"])
            start = stop


def _sharing(rows: DataFrame, similarity: float, limit: int) -> DataFrame:
    """id, other: every pair of rows (id, comp, size, prefix, sketch) of different comp that may be `similarity` alike.

    Only shingles that rows of several comps share keep their bucket. Buckets of over `limit` texts
    are dealt over the cells of a grid, each holding two parts of the bucket, so that every two of
    its texts still meet.
    """
    one = rows.select("comp", "id", "size", F.posexplode("prefix").alias("pos", "sig"))
    bucket = Window.partitionBy("sig")
    shared = one.withColumns({"low": F.min("comp").over(bucket), "high": F.max("comp").over(bucket), "n": F.count("*").over(bucket)}).where("low < high")
    parts = F.ceil(F.col("n") / limit).cast("int")
    cells = shared.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = cells.select("sig", "comp", "id", "size", "pos", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"))
    # within a cell of two parts only texts of different parts meet; those of one part meet in its own cell
    side = F.when(F.col("part") == F.col("to"), -1).otherwise(F.col("part")).alias("side")
    dealt = cells.select(F.xxhash64("sig", F.least("part", "to"), F.greatest("part", "to")).alias("sig"), "comp", "id", "size", "pos", side)
    dealt = dealt.join(rows.select("id", "sketch"), "id").select(*_Buckets.COLUMNS)
    return dealt.repartition("sig").sortWithinPartitions("sig", "comp").mapInArrow(_Buckets(similarity), "id long, other long").distinct()


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, propose_words: int = 2, bits: int = 256, radius: int = 52, max_shard: int = MAX_SHARD, max_bucket: int = MAX_BUCKET, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs without all but one document (the smallest doc_id) of each group of near copies.

    Two texts are near copies if the Jaccard similarity of their sets of `words`-word shingles is
    at least `similarity`; groups follow chains of these. Each proposed pair is held against the
    texts themselves. SimHash proposes first, and joins most copies with few pairs: wide
    fingerprints of the distinct short shingles, where an edit touches few shingles, dealt to
    shards by blocks of 16 bits; within a shard's BK-tree every text meets its nearest and its
    first earlier neighbour within the radius; of these pairs, only those go on that can be alike by
    their sets' sizes and sketches. Then a prefix filter proposes all the rest: two
    texts this similar share one of their rarest shingles, so every two that do, that aren't
    joined by verified links and whose sizes, places and sketches allow it, are held against each other.
    What SimHash misses therefore costs time and changes no result.

    Equal texts always meet. A repeated row (same id and text) is kept once. A null doc_id sorts
    after all others, and a null text counts as empty.
    """
    text = F.coalesce("row.text", F.lit(""))
    keyed = whole_rows(docs).withColumn("_digest", F.sha2(text, 256)).withColumn("_key", F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), "_digest"))
    made = _with_signature(keyed.select("row", "_digest"), words, similarity, propose_words, bits, "row.text")
    texts = saved(made.groupBy("_digest").agg(F.first("fingerprint").alias("fingerprint"), F.min("row.doc_id").alias("lowest"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")))
    own = F.struct(F.col("_digest").alias("digest"), "size", "sketch")
    distinct = saved(texts.groupBy("fingerprint").agg(F.min(own).alias("own")))

    blocks = bits // 16
    near = _in_shards(_dealt(distinct.select("fingerprint"), 4, blocks, blocks - 1, max_shard), lambda forest: forest.nearest(radius)).distinct()
    proposed = near.join(distinct.toDF("a", "one"), "a").join(distinct.toDF("b", "other"), "b").select("one", "other")
    same_print = texts.join(distinct, "fingerprint").where("_digest != own.digest").select(own.alias("one"), F.col("own").alias("other"))
    proposed = saved(_possible_pairs(proposed.union(same_print), similarity))

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            x, y = np.unique(shingles(x, words)), np.unique(shingles(y, words))
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0

        out = pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)
        give_back()
        return out

    def verified(proposed: DataFrame) -> DataFrame:
        involved = saved(proposed.select(F.explode(F.array("digest_a", "digest_b")).alias("_digest")).distinct())
        whole = keyed.select("_digest", text.alias("text"))
        if involved.count() <= BROADCAST_TEXTS:  # then the other texts stay where they are
            whole = whole.join(F.broadcast(involved.select(F.xxhash64("_digest").alias("_h"))), F.xxhash64("_digest") == F.col("_h"), "left_semi")
        else:
            whole = whole.join(involved, "_digest", "left_semi")
        whole = whole.groupBy("_digest").agg(F.min("text").alias("text"))
        pairs = proposed.join(whole.toDF("digest_a", "text_a"), "digest_a").join(whole.toDF("digest_b", "text_b"), "digest_b")
        return pairs.where(jaccard("text_a", "text_b") >= similarity).select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"))

    joined = components(verified(proposed))
    rows = texts.join(joined, texts._digest == joined.node, "left").select(F.xxhash64("_digest").alias("id"), F.xxhash64(F.coalesce("component", "_digest")).alias("comp"), "size", "prefix", "sketch")
    numbers = texts.select(F.xxhash64("_digest").alias("id"), "_digest")
    unlinked = _sharing(rows, similarity, max_bucket)
    unlinked = unlinked.join(numbers.toDF("id", "digest_a"), "id").join(numbers.toDF("other", "digest_b"), "other").select("digest_a", "digest_b")
    links = verified(saved(unlinked))
    group = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
    named = texts.join(group, texts._digest == group.node, "left").select("_digest", "lowest", F.coalesce("component", "_digest").alias("component"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("lowest").isNull().alias("no_id"), "lowest", "_digest")).alias("first"))
    kept = first.select(F.concat_ws(":", F.coalesce(F.col("first.lowest").cast("string"), F.lit("")), "first._digest").alias("_key"))
    return _of_keys(keyed, kept, broadcast_keys).select("row.*")


def _of_keys(keyed: DataFrame, kept: DataFrame, most: int) -> DataFrame:
    """One row of keyed for each key that is kept.

    Keys that are dropped or repeated are few beside all rows: up to `most` of them are broadcast, and
    all other rows stay where they are.
    """
    keys = keyed.groupBy("_key").agg(F.count("*").alias("n")).join(kept.select("_key", F.lit(True).alias("_kept")), "_key", "left")
    special = saved(keys.where("_kept is null or n > 1").select("_key", F.coalesce("_kept", F.lit(False)).alias("_kept")))
    if special.count() > most:
        return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"])
    one, two = F.xxhash64("_key"), F.xxhash64(F.reverse("_key"))  # neither follows from the other
    rows = keyed.select("row", "_key", one.alias("_one"), two.alias("_two")).join(F.broadcast(special.select(one.alias("_one"), two.alias("_two"), "_kept")), ["_one", "_two"], "left")
    return rows.where("_kept is null").select("row").union(rows.where("_kept").dropDuplicates(["_key"]).select("row"))
