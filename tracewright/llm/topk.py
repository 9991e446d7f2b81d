"""Exact top-k inner products by tiled matrix products.

Candidates are packed into tiles and queries into blocks, both as binary rows.  Each tile belongs to one of
``groups`` groups; every query block goes once to each group, so that what is sent is the candidates once and
the (much smaller) queries ``groups`` times.  A product of one block by one tile keeps k scores of each query;
the lists are merged in two steps, within tasks and then by query.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of
different lengths aren't compared; ties go to the smaller id; a repeated id counts as often as it stands;
without candidates a query has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, partitions_for

TILE, GROUP = 2048, 65_536


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as double; null if the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    # a comparison with null is null, so that a null component makes no part of a sound vector
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return F.when(sound, whole)


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (id, vector of long) as blocks: dim, ids and matrix, TILE vectors at most."""

    def run(batches):
        for batch in batches:
            lengths = np.array([-1 if v is None else v for v in pc.list_value_length(batch.column(1)).to_pylist()], int)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths >= 0]).tolist():
                chosen = np.flatnonzero(lengths == dim)
                values = batch.column(1).take(pa.array(chosen)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(chosen), dim)
                for k in range(0, len(chosen), TILE):
                    part = slice(k, k + TILE)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[chosen[part]].astype(np.int64).tobytes()], pa.binary()), pa.array([values[part].tobytes()], pa.binary())], ["dim", "ids", "matrix"])

    return in_arrow(rows, run, "dim int, ids binary, matrix binary")


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, tile: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of a tile for each query, the query's own id left out."""
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(tile).max(initial=0)) * max(1, queries.shape[1])
    # doubles hold these sums exactly, and their product is the fast one
    scores = (queries.astype(float) @ tile.astype(float).T).astype(np.int64) if limit < 2**53 else queries @ tile.T
    low = np.iinfo(np.int64).min
    scores[query_ids[:, None] == ids[None, :]] = low
    n = len(ids)
    if n > k:
        # every column that reaches the k-th best score is kept, so that ties are settled by id below
        bound = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, columns = np.nonzero((scores >= bound[:, None]) & (scores > low))
    else:
        rows, columns = np.nonzero(scores > low)
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    rows, columns = rows[keep], columns[keep]
    return query_ids[rows], ids[columns], scores[rows, columns]


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, groups: int | None = None) -> DataFrame:
    """Of rows (id, vector of long) on both sides: query_id, rank from 1, vec_id, score."""
    queries = queries.select(F.col("id").cast("long").alias("id"), "vector").filter("id IS NOT NULL AND vector IS NOT NULL")
    candidates = candidates.select(F.col("id").cast("long").alias("id"), "vector").filter("id IS NOT NULL AND vector IS NOT NULL")
    if groups is None:
        groups = partitions_for(candidates.count(), GROUP)
    tiles = _packed(candidates).withColumn("grp", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    blocks = _packed(queries).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = tiles.join(blocks.withColumnsRenamed({"ids": "query_ids", "matrix": "query_matrix"}), ["grp", "dim"])

    def run(batches):
        for batch in batches:
            for dim, ids, matrix, query_ids, query_matrix in zip(*(batch.column(i).to_pylist() for i in range(5))):
                q, c, s = best(np.frombuffer(query_ids, np.int64), np.frombuffer(query_matrix, np.int64).reshape(-1, dim), np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(-1, dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, c, s)], ["query_id", "vec_id", "score"])

    lists = in_arrow(pairs.select("dim", "ids", "matrix", "query_ids", "query_matrix"), run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
