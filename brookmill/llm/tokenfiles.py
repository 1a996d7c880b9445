"""Token-id files: documents in ascending id, each shard a wavelet matrix in one compressed file.

Documents are dealt by ranges of (doc_id, hash of the text), sorted, and encoded. Every task cuts
what it has into shards of about `shard_tokens` ids and packs each as one file's content. Spark
writes these as Parquet files of a single row, so they reach any store that Spark can write.

The tokenizer drops white space and never merges over it, so the distinct words of a slice are
encoded once each, with the tokenizers library, and put together again; that gives the ids of the
whole text (the tests hold it against them). `count_tokens`, `occurrences` and `tokens_at` ask the
files by rank, select and access, without decoding them.

Nulls and edges: a null text counts as empty and yields only the end id; null ids come first, and
stay null; repeated rows are each encoded, in the order of their texts' hashes; an empty table
gives an empty folder of files. Very long texts are encoded whole. Other columns are left out.
"""

import functools
import json
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wavelet
from .common import slices, words_of

END, SHARD_TOKENS, TASK_CHARS = 1, 4_000_000, 32_000_000
#: Words whose ids a worker remembers, and words that are encoded as one text.
KNOWN_WORDS, JOINED = 400_000, 500
#: Parts that are summed up together when places are counted.
PARTS = 1024
#: Shards whose starts (three numbers each) may be broadcast; those of more are joined.
BROADCAST_SHARDS = 500_000
#: A run of ASCII marks that is cut from a word's end, after a letter or digit.
MARKS = r"[!-/:-@\[-`{-~]*$"


def _of_letters(words: pa.Array) -> np.ndarray:
    """Whether words are letters alone, before and after they are normalised."""
    lower = pc.utf8_is_alpha(pc.utf8_lower(words))
    return pc.and_(pc.and_(pc.utf8_is_alpha(words), lower), pc.equal(pc.utf8_normalize(words, "NFC"), words)).to_numpy(zero_copy_only=False)


class Encoder:
    """Ids of words by the tokenizers library; a worker remembers those it has met.

    Where the tokenizer lower-cases, cuts letters from marks and ends every word's last token by a
    suffix of its own, ASCII words are lower-cased, marks at a word's end are encoded by
    themselves, and words of letters alone many as one text.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known_words = Tokenizer.from_file(path), known_words
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        of = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.cuts = bool(suffix) and of("Stonewall, qzqz.") == [*of("stonewall"), *of(","), *of("qzqz"), *of(".")]
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.sizes, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def rows(self, words: list[str]) -> np.ndarray:
        """Of each distinct word its row in sizes and ids."""
        new = [w for w in words if w not in self.row]
        if new:
            letters = _of_letters(pa.array(new, pa.string())) if self.cuts else np.zeros(len(new), dtype=bool)
            plain, other = ([new[i] for i in np.flatnonzero(x).tolist()] for x in (letters, ~letters))
            texts = [" ".join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
            flat = self._encoded(texts)
            ids = np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint32)
            sizes = np.diff(np.append(-1, np.flatnonzero(self.ends[ids])))
            if len(sizes) != len(plain):  # the tokenizer takes some character for no letter
                plain, other, ids, sizes = [], plain + other, ids[:0], sizes[:0]
            own = self._encoded(other)
            self.row.update(zip(plain + other, range(len(self.row), len(self.row) + len(new))))
            self.sizes = np.concatenate([self.sizes, sizes, np.fromiter(map(len, own), dtype=np.int64, count=len(own))])
            self.ids = np.concatenate([self.ids, ids, *own])
        return np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each distinct word's start there and how many they are."""
        if len(self.row) > self.known_words:
            self.clear()
        if not self.cuts:
            row = self.rows(words.to_pylist())
            return self.ids, (np.cumsum(self.sizes) - self.sizes)[row], self.sizes[row]
        special = pc.match_substring(words, "<|")
        short = pc.utf8_rtrim(words, characters=string.punctuation)
        cut = pc.and_(pc.match_substring_regex(short, r"[\pL\pN]$"), pc.invert(special))
        core = pc.if_else(cut, short, words)
        mark = pc.if_else(cut, pc.struct_field(pc.extract_regex(words, pattern=f"(?P<mark>{MARKS})"), "mark"), "")
        plain = pc.and_(pc.string_is_ascii(core), pc.invert(special))
        core, mark = pc.if_else(plain, pc.ascii_lower(core), core).dictionary_encode(), mark.dictionary_encode()
        one, two = (self.rows(x.dictionary.to_pylist())[x.indices.to_numpy()] for x in (core, mark))
        first = np.cumsum(self.sizes) - self.sizes
        n, more = self.sizes[one], self.sizes[two]
        total = n + more
        ends = np.cumsum(total)
        inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - total, total)
        start = np.where(inner < np.repeat(n, total), np.repeat(first[one], total), np.repeat(first[two] - n, total))
        return self.ids[start + inner], ends - total, total


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(texts: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with the end id, and how many each has."""
    flat, bounds = words_of(texts, lower=False)
    coded = flat.dictionary_encode()
    own, first, sizes = encoder(path).of_words(coded.dictionary)
    own, first, sizes = np.append(own, np.uint32(end)).astype(np.uint32), np.append(first, len(own)), np.append(sizes, 1)
    # every text's words, then one more that stands for its end
    at = np.full(len(flat) + len(texts), len(sizes) - 1, dtype=np.int64)
    at[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = coded.indices.to_numpy()
    n = sizes[at]
    ends = np.cumsum(n)
    out = own[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    lengths = np.diff(np.append(0, ends)[np.append(0, bounds[1:] + np.arange(1, len(texts) + 1))])
    return out, lengths


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end: int = END, shard_tokens: int = SHARD_TOKENS, task_chars: int = TASK_CHARS) -> None:
    """Write documents (doc_id long, text) as token files below path."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    tasks = max(1, -(-chars // task_chars))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("at"))
    rows = rows.repartitionByRange(tasks, "doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def shard() -> pa.RecordBatch:
            ids, lengths, doc_ids, no_id = (np.concatenate(x) for x in zip(*held))
            data = wavelet.pack(ids, lengths, doc_ids, no_id)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(lengths)], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_tokens", "n_docs", "file"])

        for piece in slices(batches):
            column = piece.column("doc_id")
            ids, lengths = encode_texts(piece.column("text"), tokenizer_path, end)
            held.append((ids, lengths, column.fill_null(0).to_numpy(), ~column.is_valid().to_numpy(zero_copy_only=False)))
            if sum(len(x[0]) for x in held) >= shard_tokens:
                yield shard()
                seq, held = seq + 1, []
        if held:
            yield shard()

    files = rows.mapInArrow(run, "part int, seq int, n_tokens long, n_docs long, file binary")
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, shard_start (ids of all shards before) and file of every shard.

    Sums run within parts, within groups of parts, and over the groups, so no task sees all shards.
    """
    files = spark.read.parquet(path)
    before = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda window: F.coalesce(F.sum("n_tokens").over(window), F.lit(0))
    shards = files.select("part", "seq", "n_tokens", F.floor(F.col("part") / PARTS).alias("lot"))
    parts = shards.groupBy("lot", "part").agg(F.sum("n_tokens").alias("n_tokens"))
    lots = parts.groupBy("lot").agg(F.sum("n_tokens").alias("n_tokens")).select("lot", ahead(before("lot")).alias("of_lots"))
    parts = parts.select("lot", "part", ahead(before("part").partitionBy("lot")).alias("of_parts"))
    starts = shards.withColumn("of_shards", ahead(before("seq").partitionBy("lot", "part"))).join(parts, ["lot", "part"]).join(lots, "lot")
    starts = starts.select("part", "seq", F.expr("of_lots + of_parts + of_shards").alias("shard_start"))
    if files.count() <= BROADCAST_SHARDS:  # so that the files stay where they are
        starts = F.broadcast(starts)
    return files.select("part", "seq", "file").join(starts, ["part", "seq"])


def _in_files(files: DataFrame, columns: list[str], read, schema: str) -> DataFrame:
    """Rows that read(matrix, lengths, doc_ids, no_id, rest) returns of each file as arrays; rest: its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rest = {c: batch.column(c)[row].as_py() for c in batch.schema.names if c != "file"}
                arrays = read(*wavelet.unpack(batch.column("file")[row].as_py()), rest)
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return files.mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with_ids, ids of every document in the files."""

    def read(matrix, lengths, doc_ids, no_id, rest) -> list[pa.Array]:
        ids = matrix.all().astype("<u4")
        ends = np.cumsum(lengths)
        raw = memoryview(ids).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
        made = [pa.array(doc_ids, pa.int64(), mask=no_id), pa.array(rest["shard_start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
        if with_ids:
            made.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view("<i4"), pa.int32())))
        return made

    columns = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return _in_files(_files(spark, path), columns, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def count_tokens(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, start and n of the documents that hold the id, by rank alone."""

    def read(matrix, lengths, doc_ids, no_id, rest) -> list[pa.Array]:
        ends = np.cumsum(lengths)
        n = matrix.counts(token, ends - lengths, ends)
        some = n > 0
        return [pa.array(doc_ids[some], pa.int64(), mask=no_id[some]), pa.array((rest["shard_start"] + ends - lengths)[some]), pa.array(n[some])]

    return _in_files(_files(spark, path), ["doc_id", "start", "n"], read, "doc_id long, start long, n long")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, start (of the document) and at (place in it, from 0) of every occurrence of the id, by select."""

    def read(matrix, lengths, doc_ids, no_id, rest) -> list[pa.Array]:
        ends = np.cumsum(lengths)
        at = matrix.occurrences(token)
        doc = np.searchsorted(ends, at, side="right")
        first = (ends - lengths)[doc]
        return [pa.array(doc_ids[doc], pa.int64(), mask=no_id[doc]), pa.array(rest["shard_start"] + first), pa.array(at - first)]

    return _in_files(_files(spark, path), ["doc_id", "start", "at"], read, "doc_id long, start long, at long")


def tokens_at(spark: SparkSession, path: str, first: int, length: int) -> DataFrame:
    """doc_id, start and ids: `length` ids of every document from its place `first` on (fewer at its end), by access."""

    def read(matrix, lengths, doc_ids, no_id, rest) -> list[pa.Array]:
        ends = np.cumsum(lengths)
        n = np.clip(lengths - first, 0, length)
        stops = np.cumsum(n)
        at = np.repeat(ends - lengths + first - (stops - n), n) + np.arange(int(stops[-1]) if len(stops) else 0)
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(matrix.access(at), pa.int32()))
        return [pa.array(doc_ids, pa.int64(), mask=no_id), pa.array(rest["shard_start"] + ends - lengths), ids]

    return _in_files(_files(spark, path), ["doc_id", "start", "ids"], read, "doc_id long, start long, ids array<int>")
