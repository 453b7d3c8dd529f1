"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots, cut at ``DEPTH``.  Rows are
indexed once, in chunks of about ``CHUNK``: a chunk has an inverted file for each pivot, which
posts the pivot's place in the order of every row (DEPTH for rows that do not have it; with
DEPTH pivots of PIVOTS posted a file holds half of the rows, so a place for each is shorter
than a list of rows).  A query reads the files of its own DEPTH nearest pivots, adds up the
differences of places, which is the footrule distance of the orders as far as the query knows them,
and reranks the ``SHARE`` of each chunk that stands first by exact distance.  Each block of
queries visits each chunk, so neither side is ever gathered or broadcast whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.plans.scratch import materialize

PIVOTS, DEPTH = 256, 128
#: Pivots are drawn from the SAMPLE vectors of least hash, which also tell the common length.
SAMPLE = 4096
#: The part of a chunk that is reranked, and the least number of rows.
SHARE, LEAST = 0.08, 256
CHUNK, QUERY_BLOCK, QUERIES_AT_ONCE = 8192, 16384, 64


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)


def places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots): the place of each pivot in the order of the row's nearest ones, DEPTH at most; ties go by number."""
    order = np.argsort(_squares(x, pivots), 1, kind="stable")
    depth = min(DEPTH, len(pivots))
    out = np.full(order.shape, depth, np.int16)
    np.put_along_axis(out, order[:, :depth], np.arange(depth, dtype=np.int16)[None], 1)
    return out


def fit(vectors: DataFrame) -> np.ndarray | None:
    """PIVOTS vectors of the SAMPLE, those of least hash, of the sample's commonest length; None if there is no usable vector."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").toPandas()
    if not len(got):
        return None
    lengths = got.embedding.map(len)
    common = lengths.value_counts().sort_index(ascending=False).idxmax()  # ties go to the longer
    return np.stack(got.embedding[lengths == common].to_numpy())[:PIVOTS].astype(np.float64)


def post(vectors: DataFrame, pivots: np.ndarray, chunks: int) -> DataFrame:
    """The index: a row a chunk, with its rows' numbers, ids and vectors, and the files of all pivots one after another."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("uid", kind="stable")
        x = np.stack(p.embedding.to_numpy())
        files = np.ascontiguousarray(places(x, pivots).T)
        return pd.DataFrame({"chunk": p.chunk.iloc[:1], "uids": [p.uid.to_numpy().tobytes()], "ids": [p.vec_id.to_numpy().tobytes()], "vectors": [x.tobytes()], "files": [files.tobytes()]})

    v = vectors.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int"))
    return materialize(v.groupBy("chunk").applyInPandas(one, "chunk int, uids binary, ids binary, vectors binary, files binary"), "ann")


def search_chunk(files: np.ndarray, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest among the rows of a chunk that stand first by footrule distance."""
    own = places(queries, pivots)
    depth, n = min(DEPTH, len(pivots)), len(x)
    keep = min(n, max(LEAST, k + 1, int(np.ceil(SHARE * n))))
    out: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(queries), QUERIES_AT_ONCE):
        q = np.arange(start, min(start + QUERIES_AT_ONCE, len(queries)))
        foot = np.zeros((len(q), n), np.int32)
        for pivot in np.flatnonzero((own[q] < depth).any(0)):
            asks = np.flatnonzero(own[q, pivot] < depth)
            foot[asks] += np.abs(files[pivot][None] - own[q[asks], pivot][:, None])
        foot[ids[None] == query_ids[q][:, None]] = np.iinfo(np.int32).max  # a query's own row is no neighbour
        for i, line in zip(q.tolist(), foot, strict=True):
            c = np.argpartition(line, keep - 1)[:keep] if keep < n else np.arange(n)
            c = c[ids[c] != query_ids[i]]
            d = np.sqrt(((x[c] - queries[i]) ** 2).sum(1))
            best = np.lexsort((ids[c], d))[:k]
            out.append((np.full(len(best), i), c[best], d[best]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found rows of other ids, by Euclidean distance.

    Both tables have vec_id and embedding.  Vectors that are null, zero, of another length
    than most of the sample, or with null or non-finite components take no part; rows that repeat an
    id are one neighbour each, and never neighbours of a query of their own id; queries that
    repeat an id are one query, each neighbour at its least distance from any of their
    vectors; ties go to the smaller vec_id; fewer rows than k are all returned; an empty table gives an
    empty result; other columns are not read.
    """
    double = F.col("embedding").cast("array<double>").alias("embedding")
    usable_rows = lambda t: t.select(F.col("vec_id").cast("long"), double).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    v, q = usable_rows(vectors), usable_rows(queries).distinct()
    pivots = fit(v)
    if pivots is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimensions = pivots.shape[1]
    v, q = (t.where(F.size("embedding") == dimensions) for t in (v, q))
    chunks, blocks = (max(1, -(-t.count() // n)) for t, n in ((v, CHUNK), (q, QUERY_BLOCK)))
    index = post(v.withColumn("uid", F.monotonically_increasing_id()), pivots, chunks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", every(blocks))
    right = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))

    def one(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({"query_id": [], "uid": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "uid": "int64", "vec_id": "int64"})
        row = held.iloc[0]
        uids, ids = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids"))
        x, files = np.frombuffer(row.vectors).reshape(len(ids), dimensions), np.frombuffer(row.files, np.int16).reshape(-1, len(ids))
        of = asked.vec_id.to_numpy()
        a, b, d = search_chunk(files, ids, x, of, np.stack(asked.embedding.to_numpy()), pivots, k)
        return pd.DataFrame({"query_id": of[a], "uid": uids[b], "vec_id": ids[b], "score": d})

    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(one, "query_id long, uid long, vec_id long, score double")
    found = found.groupBy("query_id", "uid", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
