"""Packing against plain searches for the tightest window, and every id of every document."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brookmill.llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(rows) -> list[tuple]:
    """(doc_id, ids) of each document, by the tokenizers library."""
    own = Tokenizer.from_file(PATH)
    return [(d, [*own.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


def held(pieces: pd.DataFrame, docs: list[tuple], capacity: int, slack: int | None) -> None:
    """Each id of each document lies in one piece, sequences are gapless, and padding is small."""
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]]
        n = own.length.sum()
        assert 0 < n <= capacity
        if slack is not None:
            assert n & (n - 1) == 0 or capacity - n <= slack
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    ids = dict(docs)
    for r in pieces.itertuples():
        own = ids[None if pd.isna(r.doc_id) else r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == crc(own[r.start : r.start + r.length])
    repeats = pd.Series([d for d, _ in docs]).value_counts(dropna=False)
    for d, own in pieces.groupby("doc_id", dropna=False):
        times = repeats[d] if not pd.isna(d) else sum(k is None for k, _ in docs)
        cover = np.zeros(own.doc_tokens.iloc[0] + 1, dtype=int)
        np.add.at(cover, own.start.to_numpy(int), 1)
        np.add.at(cover, (own.start + own.length).to_numpy(int), -1)
        assert (np.cumsum(cover)[:-1] == times).all()
    assert len(repeats) == pieces.doc_id.nunique(dropna=False)


def test_op13(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = queries.op13_packing(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    held(got.toPandas(), whole(zip(docs.doc_id, docs.text)), 4096, packing.SLACK)


@pytest.mark.parametrize("seed", range(6))
def test_tightest_window(seed):
    pick, capacity = random.Random(seed), 64
    lengths = sorted((pick.randint(1, capacity) for _ in range(300)), reverse=True)
    window, offset, n = packing.best_fit(lengths, capacity)
    room: list[int] = []
    for length, w, at in zip(lengths, window, offset):
        fits = [r for r in room if r >= length]
        if w == len(room):
            assert not fits
            room.append(capacity)
        assert room[w] == (min(fits) if fits else capacity) and at == capacity - room[w]
        room[w] -= length
    assert n == len(room)


@pytest.mark.parametrize(("low", "high"), [(1, 40), (2500, 2500), (4096, 9000), (1, 9000), (4097, 4097), (4096, 4096)])
@pytest.mark.parametrize("slack", [None, 0, 32])
def test_lay(low, high, slack):
    pick = random.Random(low + high)
    lengths = sorted((pick.randint(low, high) for _ in range(200)), reverse=True)
    pieces = packing.lay(lengths, slack=slack)
    used: dict = {}
    for _, _, length, sequence, at in sorted(pieces, key=lambda p: p[3:]):
        assert used.setdefault(sequence, 0) == at and length > 0
        used[sequence] += length
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 4096
    for item, length in enumerate(lengths):
        own = sorted((p[1], p[2]) for p in pieces if p[0] == item)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) == length
    if slack is None:
        assert len(pieces) == sum(-(-n // 4096) for n in lengths)
    else:
        assert all(n & (n - 1) == 0 or 4096 - n <= slack for n in used.values())


@pytest.mark.parametrize("shard_tokens", [50, 10**6])
def test_edges(spark, shard_tokens):
    long = "The old river runs past seven quiet mills. " * 6000
    given = [(1, "Good morning"), (2, None), (3, ""), (4, long), (4, long), (None, "no id"), (5, "<|endoftext|> x"), (6, "tie one"), (7, "tie one")]
    docs = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS ids", "3 AS sequence_id").coalesce(2)
    made = packing.pack(docs, PATH, shard_tokens=shard_tokens, with_ids=True)
    held(made.drop("ids").toPandas(), whole(given), 4096, packing.SLACK)
    assert made.drop("ids").collect() == made.drop("ids").collect()
    assert packing.pack(docs.limit(0), PATH).count() == 0
    ids = dict(whole(given))
    for r in packing.sequences(made, pad=0).collect():
        n = r.n_tokens
        assert len(r.ids) == (n if n & (n - 1) == 0 else 4096) and not any(r.ids[n:])
        for d in r.docs:
            own = ids[d.doc_id]
            assert any(own[k : k + d.length] == r.ids[d.offset : d.offset + d.length] for k in range(len(own) - d.length + 1))
