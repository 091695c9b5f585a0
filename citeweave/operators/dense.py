"""The k most similar rows of each of a stated set of queries, by matrix products over blocks.

Queries that fit QUERY_BYTES go to every task, whose rows are compared as they are read; more queries are cut into
blocks, and each block of rows meets each block of queries in a task of its own. Either way a task keeps k rows per
query, so what is shuffled does not grow with the rows of a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the query vectors that are sent to every task, at most; rows of a block where they are more.
QUERY_BYTES, ROW_BLOCK = 64_000_000, 100_000
#: Numbers of a matrix of scores that a task holds at once.
SCORES = 2_000_000


class Best:
    """The k best rows so far of each query, ties going to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.bar = k, np.full(n, -np.inf)
        self.q, self.row, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores is (queries, rows); -inf leaves a row out."""
        k = min(self.k, scores.shape[1])
        bar = np.maximum(self.bar, np.partition(scores, -k, axis=1)[:, -k]) if scores.shape[1] else self.bar
        x, y = np.nonzero((scores >= (bar if scores.shape[1] >= self.k else self.bar)[:, None]) & (scores > -np.inf))
        q, row, score = np.concatenate([self.q, x]), np.concatenate([self.row, ids[y]]), np.concatenate([self.score, scores[x, y]])
        order = np.lexsort((row, -score, q))
        q, row, score = q[order], row[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.bar[q[last]] = score[last]
        kept = place < self.k
        self.q, self.row, self.score = q[kept], row[kept], score[kept]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _cut(x: np.ndarray, dim: int) -> np.ndarray:
    """The first dim components brought to unit length; x itself where dim is 0 or not below its size."""
    if not 0 < dim < x.shape[1]:
        return x
    head = x[:, :dim]
    return head / np.maximum(np.linalg.norm(head, axis=1, keepdims=True), 1e-12)


def top_similar(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id", vec: str = "embedding", dims: tuple[int, ...] = (0,), member: str | None = None, same: str | None = None, least: float | None = None, distinct: bool = True) -> DataFrame:
    """(variant, q, row_id, score, rank): of each query the k rows with the largest dot product, itself left out unless `distinct` is false.

    Ids are longs, unique; score is rounded to 9 decimals and raised to `least`; ties go to the smaller id. There is a
    variant per entry of dims: vectors cut to so many components and brought to unit length (0: as they are). `member`
    is an array column of the variants a row takes part in (all without it), `same` a text column that must be equal
    (nulls never are). Null vectors, and rows whose vector is not as long as the queries', are left out; no queries give
    no rows.
    """
    spark = rows.sparkSession
    out = f"variant int, q long, {row_id} long, score double"
    extra = [F.col(member).alias("m")] if member else []
    extra += [F.col(same).alias("s")] if same else []
    r = rows.where(F.col(vec).isNotNull()).select(F.col(row_id).cast("long").alias("i"), F.col(vec).alias("v"), *extra)
    q = queries.where(F.col(vec).isNotNull()).select(F.col(row_id).cast("long").alias("i"), F.col(vec).alias("v"), *([F.col(same).alias("s")] if same else []))
    n, size = q.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], f"{out}, rank int")
    r, q = r.where(F.size("v") == size), q.where(F.size("v") == size)

    def compare(qs: pd.DataFrame, batches) -> pd.DataFrame:
        ids, x = qs["i"].to_numpy(), _matrix(qs["v"])
        cut = [_cut(x, d) for d in dims]
        best = [Best(len(ids), k) for _ in dims]
        step = max(1, SCORES // max(1, len(ids)))
        for b in batches:
            for at in range(0, len(b), step):
                part = b.iloc[at : at + step]
                rid, y = part["i"].to_numpy(), _matrix(part["v"])
                out_of = ids[:, None] == rid[None, :] if distinct else np.zeros((len(ids), len(rid)), bool)
                if same:
                    a, c = qs["s"].to_numpy(object), part["s"].to_numpy(object)
                    out_of |= (a[:, None] != c[None, :]) | pd.isna(c)[None, :]
                for j, d in enumerate(dims):
                    s = np.round(cut[j] @ _cut(y, d).T, 9)
                    if least is not None:
                        s = np.maximum(s, least)
                    s[out_of] = -np.inf
                    if member:
                        s[:, ~np.array([j in m for m in part["m"]])] = -np.inf
                    best[j].add(s, rid)
        return pd.concat([pd.DataFrame({"variant": np.int32(j), "q": ids[b.q], row_id: b.row, "score": b.score}) for j, b in enumerate(best)])

    if n * size * 8 <= QUERY_BYTES:  # the size is checked; beyond it queries meet rows block by block
        shared = spark.sparkContext.broadcast(q.toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield compare(shared.value, batches)

        found = r.mapInPandas(run, out)
    else:
        nq, nr = math.ceil(n * size * 8 / QUERY_BYTES), math.ceil(r.count() / ROW_BLOCK)
        part = lambda x, m: F.pmod(F.xxhash64("i"), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        a = r.withColumns({"pr": part(r, nr), "is_q": F.lit(False)}).withColumn("pq", every(nq))
        b = q.withColumns({"pq": part(q, nq), "is_q": F.lit(True)}).withColumn("pr", every(nr))

        def tile(t: pd.DataFrame) -> pd.DataFrame:
            return compare(t[t["is_q"]], [t[~t["is_q"]]]) if t["is_q"].any() else pd.DataFrame({"variant": pd.Series(dtype="int32"), "q": pd.Series(dtype="int64"), row_id: pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

        found = a.unionByName(b, allowMissingColumns=True).groupBy("pr", "pq").applyInPandas(tile, out)
    w = Window.partitionBy("variant", "q").orderBy(F.desc("score"), row_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
