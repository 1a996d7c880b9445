"""Cross-tokenizer alignment: which ids of one tokenizer cover the same bytes as which of another.

Python works on distinct units. A text with a space in front is cut before each space that follows
something that isn't white space; there no token of either side goes on, so equal units have equal
tokens and links wherever they stand. A slice of documents is sent as its distinct units (links and
groups) and each document's list of units; Spark puts the documents together.

All distinct units of a slice are aligned at once, laid end to end, by numpy and Arrow. Offsets where
both sides end cut their tokens into groups. Two tokens overlap on one stretch of bytes, which ends
where one of them does, so each offset where either side ends stands for one link: that of the tokens
which hold the byte before it. A document has as many groups as tokens of both sides less its links.

How many documents hold a pair of ids is counted over the corpus. Counts come back to links by a
broadcast of the commonest pairs (at most `most_pairs`, chosen by how many pairs there are of each
magnitude); links of rarer pairs, of which no one is frequent, join by a shuffle.

Nulls and edges: texts that are null or empty, or whose bytes the tokens of either side don't spell,
have no tokens, zeros and ''. A null doc_id stays null; each of repeated rows is a document of its
own; an empty table gives no rows; other columns are left out. A very long text is a slice of its
own, worked on whole in about 100 bytes of memory a token.
"""

import functools
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import once
from .common import saved, shared_folder, slices

#: Bytes of text that a task aligns at once.
SLICE_BYTES = 2 << 20
#: Pairs of ids (17 bytes each) whose counts may be broadcast.
BROADCAST_PAIRS = 1_000_000


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it is visible, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.cache
def byte_level(path: str):
    """Encoder of texts by a byte-level BPE file of the tokenizers library, and the bytes of each id.

    Where merges go by ascending id, and nothing but the usual pattern comes before them, tiktoken
    works them off, over three times as fast and with the same ids; else the tokenizers library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    vocab, of, special = own["model"]["vocab"], _byte_of(), {t["content"] for t in own["added_tokens"]}
    spelled = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        spelled[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in own["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    before = own["pre_tokenizer"] or {}
    plain = own["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if plain and made == sorted(made) and not own["model"].get("ignore_merges"):
        ranks = {spelled[i]: i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, spelled
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, spelled


@functools.cache
def pieces(path: str):
    """Encoder of lists of texts by a SentencePiece model, which puts a space in front (of an empty text, too), and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(text)]
    space = [model.piece_to_id("▁")]
    return lambda texts: [ids if t else space for t, ids in zip(texts, model.encode(texts, num_threads=1))], spelled


#: A space after something that isn't white space.
_BORDER = re.compile(r"(?<=\S) ")
_NOT_AFTER_WORD = re.compile(r"\s ")


def _units(text: str, cuts: bool) -> list[str]:
    """The units of space+text, each without its first space."""
    if not cuts:
        return [text]
    return _BORDER.split(text) if text[0] == " " or _NOT_AFTER_WORD.search(text) else text.split(" ")


def _lists(values: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values in a row, and where each list's start (and the end of the last)."""
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, values), dtype=np.int64, count=len(values))))
    return np.fromiter(chain.from_iterable(values), dtype=np.int32, count=int(bounds[-1])), bounds


def _aligned(a: list[list[int]], b: list[list[int]], sizes_a: np.ndarray, sizes_b: np.ndarray) -> pa.StructArray:
    """Of each unit, by its ids of both sides, which spell the same bytes: links (ids of A * 2**32 + of B) and groups (`a1,a2|b1;a3|b2,b3`).

    sizes: the number of bytes of each id, none of them zero.
    """
    (ids_a, bounds), (ids_b, _) = _lists(a), _lists(b)
    ends_a, ends_b = np.cumsum(sizes_a[ids_a]), np.cumsum(sizes_b[ids_b])
    begin = np.append(0, ends_a)[bounds]
    held = np.zeros((2, begin[-1]), dtype=bool)  # whether a token of each side has its last byte here
    held[0, ends_a - 1] = held[1, ends_b - 1] = True
    last, cuts = np.flatnonzero(held.any(axis=0)), np.flatnonzero(held.all(axis=0))
    links = ids_a[np.searchsorted(ends_a, last, side="right")].astype(np.int64) << 32 | ids_b[np.searchsorted(ends_b, last, side="right")]

    def lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)

    def written(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pc.binary_join(lists(np.append(0, np.searchsorted(ends, cuts + 1, side="right")), pa.array(ids).cast(pa.string())), ",")

    groups = pc.binary_join_element_wise(written(ids_a, ends_a), written(ids_b, ends_b), "|")
    columns = [lists(np.searchsorted(last, begin), pa.array(links)), pc.binary_join(lists(np.searchsorted(cuts, begin), groups), ";")]
    return pa.StructArray.from_arrays(columns, ["links", "groups"])


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each slice of docs (doc_id, text), with units, an array of its distinct units (links, groups), and
    docs, an array of (doc_id, n_a, n_b, units: indexes of units in order)."""
    ints, longs = (T.ArrayType(x, False) for x in (T.IntegerType(), T.LongType()))
    of_unit = T.StructType([T.StructField("links", longs, False), T.StructField("groups", T.StringType(), False)])
    of_doc = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_a", T.LongType(), False), T.StructField("n_b", T.LongType(), False), T.StructField("units", ints, False)])
    schema = T.StructType([T.StructField("units", T.ArrayType(of_unit, False), False), T.StructField("docs", T.ArrayType(of_doc, False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, bytes_a), (encode_b, bytes_b) = byte_level(path_a), pieces(path_b)
        sizes_a, sizes_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (bytes_a, bytes_b))
        cuts = not any(b" " in x.lstrip(b" ") for x in bytes_b)
        for piece in slices(batches, "text", SLICE_BYTES):
            own, words = [], []
            for t in piece.column("text").to_pylist():
                made = _units(t, cuts) if t else []
                own.append(len(made))
                words += made
            at, known = pd.factorize(np.array([*words, None], dtype=object)[:-1])
            a, b = [encode_a(" " + w) for w in known], encode_b(list(known))
            spelled = [b"".join([bytes_a[i] for i in x]) == (raw := (" " + w).encode()) == b"".join([bytes_b[i] for i in y]) for w, x, y in zip(known, a, b)]
            ends = np.cumsum(own)
            bad = np.append(0, np.cumsum(~np.array(spelled, dtype=bool)[at]))
            told = bad[ends] == bad[ends - own]  # documents whose bytes the tokens spell
            at, own = at[np.repeat(told, own)], np.where(told, own, 0)
            bounds = np.append(0, np.cumsum(own))
            held = [np.add.reduceat(np.append(np.fromiter(map(len, x), dtype=np.int64, count=len(x))[at], 0), bounds[:-1]) * (own > 0) for x in (a, b)]
            units = _aligned(*([x if good else [] for x, good in zip(side, spelled)] for side in (a, b)), sizes_a, sizes_b)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(at, pa.int32()))
            made = pa.StructArray.from_arrays([piece.column("doc_id"), pa.array(held[0]), pa.array(held[1]), lists], ["doc_id", "n_a", "n_b", "units"])
            rows = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (units, made)]
            yield pa.RecordBatch.from_arrays(rows, ["units", "docs"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def linked(slices: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, links and groups of the documents of aligned slices."""

    def document(doc: Column, links: Column, groups: Column) -> Column:
        own = [F.flatten(F.transform(doc.units, lambda u: F.get(links, u))).alias("links"), F.concat_ws(";", F.transform(doc.units, lambda u: F.get(groups, u))).alias("groups")]
        return F.struct(doc.doc_id.alias("doc_id"), doc.n_a.alias("n_a"), doc.n_b.alias("n_b"), *own)

    made = once(F.col("units.links"), lambda a: once(F.col("units.groups"), lambda b: F.transform("docs", lambda d: document(d, a, b))))
    return slices.select(F.explode(made).alias("doc")).select("doc.*").withColumn("n_groups", F.col("n_a") + F.col("n_b") - F.size("links"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best (whether no pair of its id of A has a larger n)."""
    pairs = links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    pairs = saved(pairs)
    highest = pairs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("highest"))
    return pairs.withColumn("a", F.shiftright("pair", 32)).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _common_from(counts: DataFrame, most: int) -> int:
    """The least n = 2**k from which on there are at most `most` pairs."""
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("pairs")).collect()  # 62 rows at most
    least, total = 62, 0
    for k, pairs in sorted(((r.k, r.pairs) for r in levels), reverse=True):
        total += pairs
        if total > most:
            break
        least = k
    return 1 << least if levels and total > most else 0


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", most_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = linked(aligned(docs, path_a, path_b)).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "links", digest.alias("groups_sha256")
    )
    path = f"{shared_folder(docs.sparkSession)}/links-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    links = kept.select("row", "links")
    counts = saved(pair_counts(links))
    least = _common_from(counts, most_pairs)

    each = links.select("row", F.explode("links").alias("pair")).join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
    sums = lambda rows: rows.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    worth = lambda times: (F.col("row"), (F.col("n") * times).alias("count_sum"), F.when(F.col("best"), times).otherwise(0).cast("long").alias("n_best"))
    found = sums(each.where("n is not null").select(*worth(F.lit(1))))
    if least:
        rare = each.where("n is null").groupBy("row", "pair").agg(F.count("*").alias("times"))
        rare = rare.join(counts.where(F.col("n") < least), "pair").select(*worth(F.col("times")))
        found = sums(found.unionByName(sums(rare)))
    none = F.lit(0).cast("long")
    kept = kept.drop("links").join(found, "row", "left")
    return kept.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
