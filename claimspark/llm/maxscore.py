"""Exact top-k by inner product with MaxScore, over shards of the candidates.

Components are the terms of a vector, a shard's column of a component is that
term's posting list, and impacts are counted from the least contribution the
term can make in the shard, so that they are never negative. For each query the
terms are ordered by their greatest impact. Terms whose greatest impacts
together cannot lift a candidate over the k-th best score so far are
non-essential. The essential lists are traversed for all candidates; the others
are probed, strongest first, only for candidates that can still compete. The
threshold rises from block to block of a shard; the shards' best are merged.

The queries are dealt in blocks, and every (shard, block) pair is a group of
bounded size. All sums are exact integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard, queries of a block, candidates scored between two thresholds, terms probed at once.
SHARD, BLOCK, STEP, PROBE = 16384, 1024, 4096, 8


class Shard:
    """The posting lists of one shard's candidates: a column for each term."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((copies, ids))
        self.ids, self.copies, self.vectors = ids[order], copies[order], vectors[order]
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)

    def top(self, query: np.ndarray, k: int, own: int | None, copy: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, row), ties to the smaller id; the row of the query itself is left out."""
        least = np.minimum(query * self.low, query * self.high)
        impact = np.maximum(query * self.low, query * self.high) - least  # greatest of each term
        terms = np.argsort(-impact, kind="stable")
        terms = terms[impact[terms] > 0]
        after = np.concatenate([np.cumsum(impact[terms][::-1])[::-1], [0]])  # what the terms from here on can add
        base = int(least.sum())
        best = np.empty(0, np.int64), np.empty(0, np.int64)
        for start in range(0, len(self.ids), STEP):
            rows = np.arange(start, min(start + STEP, len(self.ids)))
            if own is not None:
                rows = rows[(self.ids[rows] != own) | (self.copies[rows] != copy)]
            threshold = best[0][-1] if len(best[0]) == k else None
            weak = np.flatnonzero(base + after <= threshold) if threshold is not None else []
            essential = int(weak[0]) if len(weak) else len(terms)
            sums = np.full(len(rows), base, np.int64)
            at = 0
            while at < len(terms) and len(rows):
                some = terms[at:at + PROBE] if at >= essential else terms[at:essential]
                sums += (self.vectors[np.ix_(rows, some)] * query[some] - least[some]).sum(axis=1)
                at += len(some)
                if threshold is not None:
                    alive = sums + after[at] > threshold  # equal scores lose: earlier rows have smaller ids
                    rows, sums = rows[alive], sums[alive]
            score = np.concatenate([best[0], sums])
            row = np.concatenate([best[1], rows])
            order = np.lexsort((row, -score))[:k]
            best = score[order], row[order]
        return list(zip(best[0].tolist(), best[1].tolist()))


def _fits(largest: float, terms: int) -> bool:
    return 4 * largest * largest * max(1, terms) < 2 ** 62


def _matrix(rows: pd.Series, terms: int) -> np.ndarray:
    """Vectors as rows of equal length, missing components 0."""
    out = np.zeros((len(rows), terms), np.float64)
    for k, v in enumerate(rows):
        out[k, :len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest scores: ``query_id, rank, vec_id, score, query_copy``.

    ``is_query``: a condition on ``id_col``. Components become
    floor(scale * x). Vectors that are null or hold a null or non-finite
    component take no part; shorter vectors are filled with zeros; empty ones
    score 0. Rows that share an id are vectors of their own, numbered by
    ``query_copy``, and find each other. A null id is never a query and comes
    last among ties. Scores must fit in 64 bits, else the job fails.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale).cast("double") * x.cast("double")).cast("double"))
    good = F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, whole).alias("v")).filter("v IS NOT NULL")
    rows = rows.withColumn("query", F.coalesce(is_query(F.col("id")), F.lit(False)))
    n, asked, terms, largest = rows.agg(F.count("*"), F.count_if("query"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, query_copy int")
    if not _fits(largest or 0.0, terms):
        raise OverflowError(f"components of up to {largest} can overflow a 64-bit score")
    shards, blocks = -(-n // SHARD), max(1, -(-asked // BLOCK))

    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("v")))

    def every(count: int):
        return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))

    h = F.xxhash64("id", "copy")
    shard, block = F.pmod(h, F.lit(shards)), F.pmod(F.xxhash64(F.lit(7), "id", "copy"), F.lit(blocks))
    candidates = rows.select("id", "copy", "v", shard.alias("shard"), F.explode(every(blocks)).alias("block"))
    queries = rows.filter("query").select("id", "copy", "v", F.explode(every(shards)).alias("shard"), block.alias("block"))

    def search(key, mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(asked):
            last = np.iinfo(np.int64).max
            ids = mine["id"].astype("Int64").fillna(last).to_numpy(np.int64)
            unnamed = mine["id"].isna().to_numpy()
            copies = mine["copy"].to_numpy(np.int64) + np.where(unnamed, 1 << 40, 0)  # after a row that has the largest id
            part = Shard(ids, copies, _matrix(mine["v"], terms).astype(np.int64))
            for own, copy, query in zip(asked["id"], asked["copy"], _matrix(asked["v"], terms).astype(np.int64)):
                for score, row in part.top(query, k, int(own), int(copy)):
                    out.append((int(own), int(copy), None if part.copies[row] > 1 << 39 else int(part.ids[row]), int(part.copies[row]), score))
        found = pd.DataFrame(out, columns=["query_id", "query_copy", "vec_id", "copy", "score"])
        return found.astype({"query_id": "int64", "query_copy": "int32", "vec_id": "Int64", "copy": "int64", "score": "int64"})

    near = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(
        search, "query_id long, query_copy int, vec_id long, copy long, score long")
    order = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "copy")
    return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "query_copy"))
