"""Nearest neighbours by a block matrix join of int8 tiles.

The queries are cut into blocks and the candidates into stripes; each pair of a query block and a stripe
is one group of one task. A group holds its query block and streams its candidates: int8 codes give the
inner products of a tile as exact integers, the residuals of the codes bound each product's error, and
only pairs whose upper bound reaches the query's k-th best so far are recomputed in double precision.
Each query of a group keeps a bounded heap of k (as a sorted array); the heaps of all stripes are merged at the end.

Vectors travel in the column's own type (four bytes a component of floats), and are coded where they meet. Codes
alone would take a byte, but a dense cluster within their error bounds would then leave most of its pairs to a
later join; beside the vectors, what a query keeps is bounded by k whatever the data. Candidates travel once for
each QUERY_COMPONENTS components of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.llm.common import by_run, sliced
from isobar.llm.vectors import matrix, usable

#: Components of the queries held by a group (16 MB of doubles), queries and candidates in one tile, and candidates that a stripe holds at least and at most.
QUERY_COMPONENTS = 1 << 21
QUERY_TILE, TILE = 2048, 2048
STRIPE_ROWS, STRIPE_MOST = 2048, 1 << 20


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (in floats that hold their products exactly), scales, and the norms of the decoded vectors and of the residuals."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127.0, 1.0)
    code = np.rint(x / scale[:, None])
    back = code * scale[:, None]
    exact = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64
    return code.astype(exact), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, as any engine sums them."""
    out = x[:, 0] * y[:, 0]
    for d in range(1, x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


class Heaps:
    """The k best (score, smaller id first among equals) of each query of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.code, self.scale, self.norm, self.gone = quantised(x)
        self.score = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, y: np.ndarray) -> None:
        coded = quantised(y)
        for at in range(0, len(self.ids), QUERY_TILE):
            self._tile(at, ids, y, *coded)

    def _tile(self, first: int, ids: np.ndarray, y: np.ndarray, code: np.ndarray, scale: np.ndarray, norm: np.ndarray, gone: np.ndarray) -> None:
        own = np.s_[first : first + QUERY_TILE]
        about = (self.code[own] @ code.T).astype(np.float64) * self.scale[own, None] * scale[None, :]
        # |xy - x'y'| <= |x'||y - y'| + |x - x'||y|, with |y| <= |y'| + |y - y'|, and a little for rounding
        slack = self.norm[own, None] * gone[None, :] + self.gone[own, None] * (norm + gone)[None, :]
        slack += 1e-12 * (self.norm + self.gone)[own, None] * (norm + gone)[None, :]
        about[self.ids[own, None] == ids[None, :]] = -np.inf
        floor = self.score[own, -1]
        if len(ids) > self.k:  # the k-th largest lower bound of this tile is another floor
            low = about - slack
            floor = np.maximum(floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, c = np.nonzero((about + slack >= floor[:, None]) & (about > -np.inf))
        for at in range(0, len(q), 200_000):
            here = np.s_[at : at + 200_000]
            self._push(first + q[here], ids[c[here]], products(self.x[first + q[here]], y[c[here]]))

    def _push(self, q: np.ndarray, who: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(q)
        all_q = np.concatenate([q, np.repeat(rows, self.k)])
        all_w = np.concatenate([who, self.who[rows].ravel()])
        all_s = np.concatenate([score, self.score[rows].ravel()])
        order = np.lexsort((all_w, -all_s, all_q))
        all_q, all_w, all_s = all_q[order], all_w[order], all_s[order]
        first = np.r_[True, all_q[1:] != all_q[:-1]]
        place = np.arange(len(all_q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = place < self.k
        self.who[all_q[keep], place[keep]] = all_w[keep]
        self.score[all_q[keep], place[keep]] = all_s[keep]

    def rows(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.who[q, place]), pa.array(self.score[q, place])], names=["query_id", "id", "score"])


def _stream(k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vecs, heaps = None, [], [], None
        wait_i: list[np.ndarray] = []
        wait_v: list[np.ndarray] = []

        def flush() -> None:
            if heaps is not None and wait_i:
                heaps.offer(np.concatenate(wait_i), np.concatenate(wait_v))
            wait_i.clear()
            wait_v.clear()

        for batch in batches:
            keys, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != key:
                    flush()
                    if heaps is not None:
                        yield heaps.rows()
                    key, ids, vecs, heaps = keys[a], [], [], None
                i, v = batch.column(2).slice(a, b - a).to_numpy(), matrix(batch.column(3).slice(a, b - a))
                if kind[a] == 0:
                    ids.append(i)
                    vecs.append(v)
                    continue
                if heaps is None and ids:
                    heaps = Heaps(np.concatenate(ids), np.concatenate(vecs), k)
                if heaps is not None:
                    wait_i.append(i)
                    wait_v.append(v)
                    if sum(map(len, wait_i)) >= TILE:
                        flush()
        flush()
        if heaps is not None:
            yield heaps.rows()

    return f


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product with each query row, the row itself left out; exact.

    is_query is a condition on the columns of vectors. Returns query_id, rank (from 1, nearest first, ties
    to the smaller id), the neighbour's id and score (double). A query with fewer candidates gets them all.
    Vectors that are null, empty or zero, or hold null or non-finite components, are neither queries nor
    candidates; vectors of unlike lengths are not compared. Ids are taken to be unique: of rows with a
    repeated id, each is a candidate. An empty table, or no query, gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, as_it_is=True)
    queries = usable(vectors.where(is_query), id_col, vec_col, as_it_is=True)
    counted = vectors.agg(F.count("*").alias("n"), F.sum(F.when(is_query, F.greatest(F.size(vec_col), F.lit(0)))).alias("held")).first()
    blocks = max(1, -(-(counted["held"] or 0) // QUERY_COMPONENTS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    stripes = max(1, min(max(parts // blocks, -(-counted["n"] // STRIPE_MOST)), counted["n"] // STRIPE_ROWS))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    stripe = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(stripes))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("id", "v", "dim", block.alias("b")).withColumn("s", each(stripes)).withColumn("kind", F.lit(0))
    c = rows.select("id", "v", "dim", stripe.alias("s")).withColumn("b", each(blocks)).withColumn("kind", F.lit(1))
    dealt = q.unionByName(c).select(F.xxhash64("b", "s", "dim").alias("key"), "kind", "id", "v")
    found = by_run(dealt, "key", "kind", _stream(k), "query_id long, id long, score double", blocks * stripes)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")


#: The 20 nearest of `embeddings` to rows whose vec_id is divisible by 20, in DuckDB's SQL.
ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_reduce(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]), lambda x, y: x + y) AS score
  FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""
