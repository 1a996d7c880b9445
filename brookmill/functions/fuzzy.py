"""Similarity of strings by their longest common subsequence, as vectorised UDFs."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b); bit-parallel over the characters of a."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return 100.0 * 2 * (full ^ v).bit_count() / (len(a) + len(b))


def partial_indel_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a part of the longer as long as it, or shorter at either end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    parts = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(indel_ratio(short, p) for p in parts)


def partial_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 to 100; null if either side is."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else partial_indel_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return of(a, b)


def ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 to 100; null if either side is."""

    @F.pandas_udf("double")
    def of(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return of(a, b)
