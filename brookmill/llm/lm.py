"""Language-model scores from a log-frequency Bloom filter of bigram counts.

A count c is quantised to the level 1 + floor(log2 c), and a bigram enters the filter once for
each level up to its own, under a key that holds the level. A look-up probes level after level
until one is missing; the estimate is the middle of the last level's counts. The filter is
broadcast: one segment for each bucket of bigrams, about `bits` bits for each entry, so that a
bigram never seen is found with a probability of about one in 300. Whole segments are put
together into blocks of `max_filter_bytes` at most, and a scorer holds one block at a time, so that
every bigram stays in the filter at every size and memory stays bounded.

Witten-Bell smoothing joins the estimate with the exact statistics of single tokens: with t
distinct followers of a context and the sum s of their estimates, P(w|v) = (count(v,w) + t P(w)) /
(s + t), and P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). So a context's probabilities sum to 1 over the
vocabulary and the unknown, but for bigrams that the filter takes for seen by mistake. A text's end is a token, and the context of the next
text's first token.

Bigram counts are gathered without moving texts: every slice of text sends its distinct bigrams
with their counts, packed, to buckets. Contexts are spread over many buckets, so a common word
doesn't fill one. The exact statistics reach the texts by a join: texts are dealt to chunks by a
hash, every chunk asks once for each distinct word it holds, and gets the answers.

Words are known by XXH64 hashes, followers within a context by 32 bits of theirs.

Nulls and edges: a null or empty text is just its end token; repeated rows count and score each;
without training texts every token has probability 1 under the base. Whole texts count, however
long. Extra columns are left out.
"""

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, shared_folder, slices, words_of

BITS, HASHES, LEVELS = 12, 8, 48
MAX_FILTER_BYTES = 256 << 20
CHUNK_CHARS = 16_000_000
#: Characters whose bigrams are counted at once; each takes about 25 bytes of arrays.
GATHER_CHARS = 6_000_000
#: Characters that are scored at once.
PIECE_CHARS = 2_000_000
#: The end of a text; no word's bytes are a space.
END = xxhash.xxh64_intdigest(b" ")


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens (the last is the end's), each token of all texts as a place there, and where texts start."""
    flat, bounds = words_of(texts)
    coded = flat.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()] + [END], dtype=np.uint64)
    at = np.full(len(flat) + len(texts), len(known) - 1, dtype=np.int64)
    at[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = coded.indices.to_numpy()
    return known, at, np.append(0, bounds[1:] + np.arange(1, len(texts) + 1))


def bigrams(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and follower of every token; the first one's context is an end."""
    return np.append(n - 1, at[:-1]) if len(at) else at, at


def key_of(context: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """follower: the low 32 bits of its hash."""
    return mix64(context + mix64(follower.astype(np.uint64)))


def bucket_of(context: np.ndarray, follower: np.ndarray, buckets: int) -> np.ndarray:
    salt = follower.astype(np.uint64) % np.uint64(max(1, buckets // 4))
    return (mix64(context ^ mix64(salt)) % np.uint64(buckets)).astype(np.int64)


def level_of(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n.astype(float))[1], LEVELS)


def middle_of(level: np.ndarray) -> np.ndarray:
    """The estimate of a count at a level; 0 at level 0."""
    return np.where(level > 0, (2.0 ** (level - 1) + 2.0**level - 1) / 2, 0.0)


def chance(found: np.ndarray, mass: np.ndarray, followers: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """P(w|v) of the estimate found, the sum of estimates and the number of v's followers, and P(w) alone."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(followers > 0, (np.minimum(found, mass) + followers * alone) / (mass + followers), alone)


class Filter(NamedTuple):
    data: np.ndarray
    #: First byte and number of bits of each bucket's segment.
    first: np.ndarray
    size: np.ndarray

    def count(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Estimated counts of bigrams; 0: not held."""
        key, bucket = key_of(context, follower), bucket_of(context, follower, len(self.size))
        level, live = np.zeros(len(key), dtype=np.int64), np.flatnonzero(self.size[bucket] > 0)
        for j in range(1, LEVELS + 1):
            hit = live
            for place in places(key[live], j, self.size[bucket[live]]):
                if len(hit):
                    where = place[np.searchsorted(live, hit)] if len(hit) != len(live) else place
                    byte = self.first[bucket[hit]] + (where >> np.uint64(3)).astype(np.int64)
                    hit = hit[self.data[byte] >> (where & np.uint64(7)).astype(np.uint8) & 1 == 1]
            level[hit] = j
            live = hit
            if not len(live):
                break
        return middle_of(level)


def places(key: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    """Bit places of the keys at a level, by double hashing."""
    one = mix64(key + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    two = mix64(one) | np.uint64(1)
    for i in range(HASHES):
        yield (one + two * np.uint64(i)) % size.astype(np.uint64)


def segment(key: np.ndarray, n: np.ndarray, bits: int) -> bytes:
    """The filter of one bucket's bigrams."""
    level = level_of(n)
    size = -(-int(level.sum()) * bits // 64) * 64
    plane = np.zeros(size, dtype=bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        own = key[level >= j]
        for place in places(own, j, np.full(len(own), size)):
            plane[place.astype(np.int64)] = True
    return np.packbits(plane, bitorder="little").tobytes()


class Model(NamedTuple):
    #: Broadcast filters, each of some of the buckets.
    filters: list
    #: Table of word (hash), n, followers and mass (the sum of its followers' estimates).
    words: DataFrame
    tokens: int
    distinct: int


def train(docs: DataFrame, training: Column | None = None, bits: int = BITS, max_filter_bytes: int = MAX_FILTER_BYTES, chunk_chars: int = CHUNK_CHARS) -> Model:
    spark = docs.sparkSession
    rows = (docs.where(training) if training is not None else docs).select("text")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-chars // chunk_chars))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, limit=min(chunk_chars, GATHER_CHARS)):
            known, at, _ = hashed(piece.column("text"))
            context, follower = bigrams(at, len(known))
            pairs, n = np.unique(context * len(known) + follower, return_counts=True)
            context, follower = known[pairs // len(known)], known[pairs % len(known)].astype(np.uint32)
            bucket = bucket_of(context, follower, buckets)
            order = np.lexsort((follower, context, bucket))
            bucket, context, follower, n = bucket[order], context[order], follower[order], n[order].astype(np.uint32)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out = []
            for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
                own = context[a:b]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out.append((int(bucket[a]), own[first].tobytes(), np.diff(np.append(first, b - a)).astype(np.uint32).tobytes(), follower[a:b].tobytes(), n[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if not i else pa.binary()) for i in range(5)], ["bucket", "contexts", "runs", "followers", "n"])

    packed = rows.mapInArrow(gather, "bucket long, contexts binary, runs binary, followers binary, n binary")

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        joined = lambda c, kind: np.frombuffer(b"".join(group[c]), dtype=kind)
        context = np.repeat(joined("contexts", "<u8"), joined("runs", "<u4"))
        follower, n = joined("followers", "<u4"), joined("n", "<u4").astype(np.int64)
        order = np.lexsort((follower, context))
        context, follower, n = context[order], follower[order], n[order]
        first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (follower[1:] != follower[:-1])))
        context, follower, n = context[first], follower[first], np.add.reduceat(n, first)
        data = segment(key_of(context, follower), n, bits)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        return pd.DataFrame({"bucket": [group.bucket.iloc[0]], "segment": [data], "word": [context[first].astype(np.int64)], "n": [np.add.reduceat(n, first)], "followers": [np.diff(np.append(first, len(context)))], "mass": [np.add.reduceat(middle_of(level_of(n)), first)]})

    path = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    packed.groupBy("bucket").applyInPandas(reduce, "bucket long, segment binary, word array<long>, n array<long>, followers array<long>, mass array<double>").write.parquet(path)
    held = spark.read.parquet(path)
    words = held.select(F.explode(F.arrays_zip("word", "n", "followers", "mass")).alias("x")).groupBy(F.col("x.word").alias("word")).agg(F.sum("x.n").alias("n"), F.sum("x.followers").alias("followers"), F.sum("x.mass").alias("mass"))
    distinct, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    filters, block, size = [], [], 0
    for r in held.select("bucket", "segment").toLocalIterator():  # one part at a time
        if block and size + len(r.segment) > max_filter_bytes:
            filters.append(_sent(spark, block, buckets))
            block, size = [], 0
        block.append((r.bucket, bytes(r.segment)))
        size += len(r.segment)
    filters.append(_sent(spark, block, buckets))
    return Model(filters, words, tokens, distinct)


def _sent(spark: SparkSession, block: list[tuple[int, bytes]], buckets: int):
    """A broadcast filter of some buckets, of which the driver keeps no copy."""
    first, size = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    at = [b for b, _ in block]
    size[at] = [len(x) for _, x in block]
    first[at] = np.cumsum(size[at]) - size[at]
    sent = spark.sparkContext.broadcast(Filter(np.frombuffer(b"".join(x for _, x in block), dtype=np.uint8), first, size * 8))
    _let_go(sent)
    return sent


def _let_go(sent) -> None:
    """Frees the value of a broadcast in this process; the next use reads it again."""
    vars(sent).pop("_value", None)


def score(docs: DataFrame, model: Model, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row."""
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-chars // chunk_chars))))
    dealt = docs.select(chunk.alias("chunk"), "doc_id", "text").repartition("chunk").sortWithinPartitions("chunk")
    filters, tokens = model.filters, model.tokens
    total = np.log10(model.tokens + 0.5 * (model.distinct + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, limit=chunk_chars):
            number = piece.column("chunk").to_numpy()
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(number))):
                known, _, _ = hashed(piece.column("text").slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), number[a]), pa.int64()), pa.array(known.astype(np.int64))], ["chunk", "word"])

    answers = dealt.mapInArrow(ask, "chunk long, word long").join(model.words, "word").select("chunk", "word", "n", "followers", "mass")

    def judge(texts: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        own = stats.word.to_numpy(dtype=np.int64).astype(np.uint64)
        order = np.argsort(own)
        own, table = own[order], {c: stats[c].to_numpy(dtype=kind)[order] for c, kind in (("n", np.int64), ("followers", np.int64), ("mass", np.float64))}
        ends, start, cuts = np.cumsum(texts.text.fillna("").str.len().to_numpy()), 0, []
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE_CHARS, side="right")))
            cuts.append(texts.iloc[start:stop])
            start = stop
        if len(filters) == 1:
            out = [judge_piece(c, own, table, filters[0].value.count) for c in cuts]
        else:
            asked = [keys_of(c) for c in cuts]
            found = [np.zeros(len(v), dtype=np.float64) for v, _ in asked]
            for sent in filters:  # a bigram is in the block of its bucket only; elsewhere its count is 0
                block = sent.value
                for (v, w), n in zip(asked, found):
                    n += block.count(v, w)
                del block
                _let_go(sent)
            out = [judge_piece(c, own, table, lambda v, w, n=n: n) for c, n in zip(cuts, found)]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    def tokens_of(texts: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Token hashes, places and starts as of hashed(); distinct bigrams as places, and which of them each token ends."""
        known, at, starts = hashed(pa.array(texts.text, pa.string()))
        context, follower = bigrams(at, len(known))
        context[starts[:-1]] = len(known) - 1
        pairs, back = np.unique(context * len(known) + follower, return_inverse=True)
        return known, at, starts, pairs // len(known), pairs % len(known), back

    def keys_of(texts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        known, _, _, v, w, _ = tokens_of(texts)
        return known[v], known[w].astype(np.uint32)

    def judge_piece(texts: pd.DataFrame, own: np.ndarray, table: dict[str, np.ndarray], count) -> pd.DataFrame:
        known, at, starts, v, w, back = tokens_of(texts)
        place = np.minimum(np.searchsorted(own, known), max(len(own) - 1, 0))
        there = own[place] == known if len(own) else np.zeros(len(known), dtype=bool)
        n, followers, mass = (np.where(there, table[c][place], 0) if len(own) else np.zeros(len(known), dtype=np.int64) for c in ("n", "followers", "mass"))
        base = np.log10(n + 0.5) - total
        logs = np.log10(chance(count(known[v], known[w].astype(np.uint32)), mass[v], followers[v], 10.0 ** base[w]))[back]
        sums = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731  every text has its end token
        return pd.DataFrame({"doc_id": texts.doc_id, "n_tokens": np.diff(starts), "n_known": sums((n > 0)[at].astype(np.int64)), "train_tokens": tokens, "base_score": sums(base[at]), "score": sums(logs)})

    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(judge, schema)
