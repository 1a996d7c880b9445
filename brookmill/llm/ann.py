"""Approximate nearest neighbours by cosine, over sharded robust-pruned graphs.

Vectors are dealt to shards by a hash of the id: of `SHARD_ROWS` while that makes `SHARDS` at most,
then to so many, until they have `MOST_ROWS` each. Queries travel in blocks to every shard. Its
task builds a directed graph (see `vamana`): greedy searches propose neighbours, relaxed distance
pruning keeps diverse edges. There a beam search finds the best of each query, and exact cosines
on the original vectors, in double precision, decide among the whole beam. Where more nodes than
the beam holds are as near as single precision can tell, all of these are held against the query.
The work of the search grows with queries times shards.

Nulls and edges: a vector that is null, zero, empty or holds null or non-finite components takes
no part, nor does a row without an id, nor one of another length than the most common; of rows
with the same id the smallest vector counts; vectors of one direction are one node that carries
all its vectors and ids. With `k` candidates or fewer all are found. Extra columns are left out.
"""

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, FloatType
from pyspark.sql.window import Window

from . import vamana
from .common import give_back

SHARD_ROWS, MOST_ROWS, SHARDS, BLOCK_ROWS, QUERY_BEAM, TASKS = 5_000, 20_000, 24, 4_096, 96, 2_000
#: Pairs of a query and a vector that are rescored at once.
PAIRS = 50_000
#: What single precision may be wrong by in a distance 1 - cosine.
ROUNDING = 4e-6


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: cosines stay what they are, and no square overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _units(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


class Shard(NamedTuple):
    """Vectors of a shard by direction: a graph node has the distinct vectors of one direction, and these have their ids."""

    #: Distinct vectors in the order of their nodes, and where each node's start.
    vectors: np.ndarray
    of_node: np.ndarray
    #: Ids in the order of their vectors, ascending within each, and where each vector's start.
    ids: np.ndarray
    of_vector: np.ndarray
    units: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> "Shard":
        """ids: ascending."""
        vectors = vectors.astype(np.float64)
        vectors, which = np.unique(_scaled(vectors), axis=0, return_inverse=True)
        units, node = np.unique(_units(vectors), axis=0, return_inverse=True)
        by_node = np.argsort(node.ravel(), kind="stable")
        place = np.empty(len(vectors), dtype=np.int64)
        place[by_node] = np.arange(len(vectors))
        at = place[which.ravel()]
        order = np.argsort(at, kind="stable")
        starts = lambda sorted_, n: np.searchsorted(sorted_, np.arange(n + 1))
        return cls(vectors[by_node], starts(node.ravel()[by_node], len(units)), ids[order], starts(at[order], len(vectors)), units, *vamana.build(units))

    def best(self, own: np.ndarray, query: np.ndarray, k: int, beam: int) -> pd.DataFrame:
        """query_id, id and score of each query's k nearest that the beam holds."""
        query = _scaled(query)
        beam = max(beam, k + 1)
        nodes, far, _ = vamana.search(self.units, self.edges, self.entries, _units(query), beam)
        # no other node of the beam can be among the k nearest
        row, column = np.nonzero((nodes >= 0) & (far <= far[:, [k]] + 2 * ROUNDING))
        node = nodes[row, column]
        # where rounding can't tell the last of the beam from the k + 1st, or the graph led to fewer nodes than there are, all near enough are looked at
        short = (nodes[:, -1] < 0) & ((nodes >= 0).sum(axis=1) < len(self.units))
        tied = np.flatnonzero(short | (nodes[:, -1] >= 0) & (far[:, -1] <= far[:, k] + ROUNDING))
        for a in range(0, len(tied), 64):
            part = tied[a : a + 64]
            more = 1 - _units(query[part]) @ self.units.T <= far[part, k][:, None] + ROUNDING
            r, n = np.nonzero(more)
            keep = ~np.isin(row, part)
            row, node = np.append(row[keep], part[r]), np.append(node[keep], n)
        row, vector = _spread(row, self.of_node[node], self.of_node[node + 1])
        score = np.empty(len(row))
        for a in range(0, len(row), PAIRS):
            score[a : a + PAIRS] = _cosines(query[row[a : a + PAIRS]], self.vectors[vector[a : a + PAIRS]])
        first = self.of_vector[vector]
        many = np.minimum(self.of_vector[vector + 1], first + k + 1)  # further copies of a vector have larger ids, and come after these
        score, (row, at) = np.repeat(score, many - first), _spread(row, first, many)
        out = pd.DataFrame({"query_id": own[row], "id": self.ids[at], "score": score})
        out = out[out.query_id != out.id].sort_values(["query_id", "score", "id"], ascending=[True, False, True])
        return out.groupby("query_id").head(k)


def _spread(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row once for every place from its start to before its stop, and these places."""
    n = stop - start
    return np.repeat(row, n), np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and v (array of float or double): the rows whose vector takes part, with all rows of an id if they are of one length."""
    kind = df.schema[vector].dataType
    exact = isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))
    rows = df.select(F.col(id_column).alias("id"), (F.col(vector) if exact else F.col(vector).cast("array<double>")).alias("v"))
    # "contains no NaN" is unknown where a component is null
    whole = ~F.array_contains("v", F.lit(float("nan")).cast(rows.schema["v"].dataType.elementType))
    finite = (F.array_max("v") < float("inf")) & (F.array_min("v") > float("-inf"))
    rows = rows.where(F.col("id").isNotNull() & whole & finite & ((F.array_max("v") > 0) | (F.array_min("v") < 0)))
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least == most:
        return rows
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == common["n"])


def shards_of(n: int, shard_rows: int = SHARD_ROWS) -> int:
    return max(1, -(-n // max(shard_rows, MOST_ROWS)), min(-(-n // shard_rows), SHARDS))


def _distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, each with its smallest vector."""
    order = np.argsort(ids, kind="stable")
    if (ids[order[1:]] == ids[order[:-1]]).any():
        by_vector = np.lexsort(vectors.T[::-1])
        order = by_vector[np.argsort(ids[by_vector], kind="stable")]
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[first], vectors[order[first]]


def _matrix(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of these rows."""
    ids = np.concatenate([b.column("id").to_numpy(zero_copy_only=False) for b in batches])
    flat = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False) for b in batches])
    return _distinct(ids, flat.reshape(len(ids), -1))


def nearest(df: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score: the k nearest found of each row that `queries` picks.

    `queries` is a condition on the column id.
    """
    rows = usable(df, id_column, vector)
    n, n_asked = rows.agg(F.count("*"), F.count_if(queries)).first()
    shards, blocks = shards_of(n, shard_rows), max(1, -(-n_asked // BLOCK_ROWS))
    kind = rows.schema["id"].dataType
    answer = pa.schema([("query_id", to_arrow_type(kind)), ("id", to_arrow_type(kind)), ("score", pa.float64())])

    def block(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asked": [pickle.dumps(_distinct(group.id.to_numpy(), np.stack(group.v)))]})

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, packs = [], []
        for batch in batches:
            asked = batch.column("asked").is_valid()
            packs += batch.column("asked").drop_null().to_pylist()
            held.append(batch.select(["id", "v"]).filter(pa.compute.invert(asked)))
        if not sum(b.num_rows for b in held):
            return
        shard = Shard.of(*_matrix(held))
        held.clear()
        for pack in packs:
            own, query = pickle.loads(pack)
            for a in range(0, len(own), 256):
                best = shard.best(own[a : a + 256], query[a : a + 256].astype(np.float64), k, beam)
                yield pa.RecordBatch.from_pandas(best, schema=answer, preserve_index=False)
        give_back()

    packs = rows.where(queries).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(block, "asked binary")
    packs = packs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).unionByName(packs, allowMissingColumns=True)
    found = dealt.repartitionById(min(shards, TASKS), "shard").groupBy("shard").applyInArrow(answers, f"query_id {kind.simpleString()}, id {kind.simpleString()}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
