"""Language identification by rank-order profiles of character n-grams.

Every language's profile is its `size` most frequent n-grams (one to three characters) over all
its training texts. A document's own most frequent n-grams are compared with each profile by the
out-of-place distance: the sum of rank differences, where an n-gram that the profile lacks costs
`size`. The nearest profile wins; ties go to the language that sorts first.

N-grams come from the lower-cased text; whatever isn't a letter acts as one space, and an n-gram
never holds a space between two letters. N-grams are ranked by frequency, ties by code points.

Nulls and edges: a null text or a text without letters is `und` with score 0, and so is every
text when nothing could be learned; rows with a null language or text teach nothing; repeated
rows count as often as they occur; whole texts count, however long. Extra columns pass through,
unless they carry the name of an output, which then replaces them.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, give_back, slices

SIZE = 300
#: Characters that are turned into n-grams at once; longer texts are taken in pieces.
PIECE = 1 << 20
#: Bytes of training text that are counted at once; each takes about 20 bytes of arrays.
TRAIN_BYTES = 4 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@functools.cache
def _digits() -> np.ndarray:
    """Room for a digit of every code point; only those of the text at hand hold."""
    return np.zeros(0x110000, dtype=np.int64)


def _stream(text: str) -> np.ndarray:
    """Code points of the letters, with one space (as 32) before, after and between the words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = np.full(len(points) + 2, 32, dtype=np.uint32)
    np.copyto(s[1:-1], points, where=_letters()[points])
    keep = s != 32
    keep[1:] |= keep[:-1]
    keep[0] = True
    return s[keep]


def _codes(s: np.ndarray, base: int) -> np.ndarray:
    """N-grams as numbers of three digits to the base; shorter ones end in zeros.

    s: a stream, each element under the base, spaces as 1.
    """
    space = s == 1
    two = s[:-1] * base + s[1:]
    three = two[:-1] * base + s[2:]
    return np.concatenate([s[~space] * base * base, two * base, three[~space[1:-1]]]) if len(s) > 1 else s[:0]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text, ascending, as three code points of 21 bits, and their counts."""
    s = _stream(text)
    seen = []
    for start in range(0, max(len(s), 1), PIECE):
        piece = s[max(0, start - 2) : start + PIECE]
        letters = np.unique(piece)
        letters = letters[letters != 32]
        base = len(letters) + 2
        digit = _digits()
        digit[letters], digit[32] = np.arange(2, base), 1
        codes = _codes(digit[piece], base)
        if start:  # n-grams that lie within the overlap were counted before
            overlap = _codes(digit[piece[:2]], base)
        if base**3 <= max(1 << 16, 4 * len(codes)):
            n = np.bincount(codes, minlength=1)
            grams = np.flatnonzero(n)
            n = n[grams]
        else:
            grams, n = np.unique(codes.astype(np.uint32) if base < 1600 else codes, return_counts=True)
            grams = grams.astype(np.int64)
        if start and len(overlap):
            np.subtract.at(n, np.searchsorted(grams, overlap), 1)
        point = np.concatenate([[0, 32], letters]).astype(np.int64)
        seen.append((point[grams // base // base] << 42 | point[grams // base % base] << 21 | point[grams % base], n))
    if len(seen) > 1:
        grams, at = np.unique(np.concatenate([g for g, _ in seen]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in seen])).astype(np.int64)
        return grams[n > 0], n[n > 0]
    order = np.argsort(seen[0][0])
    return seen[0][0][order], seen[0][1][order]


def top(text: str, size: int) -> np.ndarray:
    """The size most frequent n-grams of a text, most frequent first, ties by code points."""
    grams, n = counted(text)
    return grams[np.lexsort((grams, -n))[:size]]


def profiles(docs: DataFrame, size: int = SIZE, text: str = "text", lang: str = "lang", training: Column | None = None) -> pd.DataFrame:
    """lang, gram, rank (from 0): the size most frequent n-grams of each language, over all training texts."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = (rows.where(training) if training is not None else rows).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, limit=TRAIN_BYTES):
            frame = piece.to_pandas()
            for name, texts in frame.groupby("lang").text:
                grams, n = counted("\n".join(texts))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= size)  # so that tasks keep no more than these
    return kept.select("lang", "gram", (F.col("rank") - 1).alias("rank")).toPandas().sort_values(["lang", "rank"])


def identify(docs: DataFrame, model: pd.DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double (1: the same ranks; 0: nothing in common)."""
    names = sorted(model.lang.unique())
    grams = np.unique(model.gram.to_numpy(dtype=np.int64))
    ranks = np.full((len(grams) + 1, max(1, len(names))), -1, dtype=np.int32)
    ranks[np.searchsorted(grams, model.gram.to_numpy(dtype=np.int64)), np.searchsorted(names, model.lang)] = model["rank"]
    sent = docs.sparkSession.sparkContext.broadcast((names, grams, ranks))

    @F.pandas_udf("lang_pred string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, grams, ranks = sent.value

        def one(t: str | None) -> tuple[str, float]:
            own = top(t, size) if t and names else ()
            if not len(own):
                return "und", 0.0
            at = np.searchsorted(grams, own)
            at[np.append(grams, -1)[at] != own] = len(grams)
            there = ranks[at]
            apart = np.where(there < 0, size, np.abs(there - np.arange(len(own))[:, None])).sum(0)
            best = int(apart.argmin())
            return names[best], 1 - apart[best] / (size * len(own))

        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])
            give_back()

    at = fresh("found", docs)
    found = docs.withColumn(at, nearest(F.col(text)))
    return found.withColumns({"lang_pred": F.col(f"{at}.lang_pred"), "score": F.col(f"{at}.score")}).drop(at)
