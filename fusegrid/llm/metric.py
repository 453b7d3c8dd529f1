"""Exact top-k search by inner product over M-trees.

The greatest inner product is the least distance once every row gets one coordinate more,
sqrt(M**2 - |x|**2) with M the longest row, and a query gets 0 there:
d(q, x)**2 = |q|**2 + M**2 - 2 q.x.  That is a metric, so M-trees can search it.

The root level is spread over the cluster: rows go to the nearest of PIVOTS routing objects, and the rows of
one of them are dealt into chunks of about CHUNK, each with the covering radius of its rows.  A chunk is an
M-tree of its own, written as one row of pages: an inner page lists routing objects with covering radii
and distances to their parent, a leaf page rows with distances to its routing object.  A query first searches the chunk of
least bound; then those chunks alone whose ball comes nearer than what it has found.  Inside a chunk pages are
taken best first, and the stored distances rule out entries by the triangle inequality before any distance to
them is computed.  All bounds leave room for rounding; scores are exact integers, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property
from heapq import heappop, heappush
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.plans.scratch import discard, materialize

#: Routing objects of the root level at most, drawn from a sample of so many rows.
PIVOTS, SAMPLE = 256, 4096
CHUNK, QUERY_BLOCK = 8192, 8192
#: Rows of a leaf page, entries of an inner page.
LEAF, FAN = 1024, 16
#: Room for rounding in bounds, as a part of the lengths that go into a distance.
SLACK = 1e-6
_EXACT = float(1 << 53)


def fixed_point(v: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component in double precision, as longs; null where a component is null or not finite, or the squared length exceeds a long."""
    d = F.col(v).cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= 2.0**32))
    return F.when(~bad & (_squares(F.transform(d, lambda x: F.floor(x * scale))) < 2.0**63), F.transform(d, lambda x: F.floor(x * scale)))


def _squares(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


@dataclass
class Tree:
    """Pages of one chunk.  Page p has the entries first[p] to first[p] + count[p]: pages, or rows if it is a leaf."""

    center: np.ndarray  # the place in ``rows`` of the row that routes a page
    radius: np.ndarray
    apart: np.ndarray  # from a page's routing object to its parent's
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    row_apart: np.ndarray  # from a row to the routing object of its leaf
    rows: np.ndarray  # the rows in order of their leaves

    @cached_property
    def pages(self) -> list[tuple[int, int, bool]]:
        """(first entry, entries, whether it is a leaf) of each page."""
        return list(zip(self.first.tolist(), self.count.tolist(), self.leaf.tolist(), strict=True))

    def pack(self) -> dict[str, bytes]:
        return {f.name: np.ascontiguousarray(getattr(self, f.name)).tobytes() for f in fields(self)}

    @staticmethod
    def unpack(row) -> Tree:
        kind = {"center": np.int32, "first": np.int32, "count": np.int32, "leaf": bool, "rows": np.int32}
        return Tree(*[np.frombuffer(row[f.name], kind.get(f.name, np.float64)) for f in fields(Tree)])


def _from(x: np.ndarray, c: int, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[rows] - x[c]) ** 2).sum(1))


def build(x: np.ndarray, most: int = LEAF) -> Tree:
    """A tree over the rows of ``x`` with leaves of ``most`` rows at most, bulk-loaded from the top: each page's rows go to the nearest of FAN of them at most; where that splits nothing, in turn."""
    pages: list[list] = [[0, np.arange(len(x)), 0.0]]
    first, count, leaf, radius = [], [], [], []
    order, row_apart, at = [], [], 0
    while at < len(pages):
        center, rows, _ = pages[at]
        at += 1
        d = _from(x, center, rows)
        radius.append(float(d.max(initial=0.0)))
        leaf.append(len(rows) <= most)
        if leaf[-1]:
            near = np.argsort(d, kind="stable")
            first.append(sum(map(len, order)))
            count.append(len(rows))
            order.append(rows[near])
            row_apart.append(d[near])
            continue
        fan = min(FAN, -(-2 * len(rows) // most))
        seeds = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
        gap = (x[rows] ** 2).sum(1)[:, None] + (x[seeds] ** 2).sum(1)[None] - 2 * (x[rows] @ x[seeds].T)
        of = gap.argmin(1)
        if np.bincount(of).max() == len(rows):
            of = np.arange(len(rows)) % fan
        kids = [(seeds[g], rows[of == g]) for g in range(fan) if (of == g).any()]
        first.append(len(pages))
        count.append(len(kids))
        apart = _from(x, center, np.array([c for c, _ in kids]))
        pages += [[c, r, float(a)] for (c, r), a in zip(kids, apart, strict=True)]
    i32 = lambda v: np.array(v, np.int32)
    rows = np.concatenate(order).astype(np.int32)
    place = np.empty(len(rows), np.int32)
    place[rows] = np.arange(len(rows))
    return Tree(place[[p[0] for p in pages]], np.array(radius), np.array([p[2] for p in pages], float), i32(first), i32(count), np.array(leaf, bool), np.concatenate(row_apart), rows)


def nearest(t: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, square: float, k: int, within: float, scale: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, computed distances): the k rows of other ids with the greatest q.x, ties to smaller ids, that may lie ``within``.

    ``x`` has the rows in the order of ``t.rows``; ``square`` is |q|**2 + M**2.
    """
    room, asked = SLACK * scale, 1
    if scale * scale >= _EXACT:  # beyond what doubles hold exactly: whole numbers
        x, q = x.astype(np.int64), q.astype(np.int64)
    best, score = np.zeros(0, np.int64), np.zeros(0, x.dtype)
    least = (square - (within + room) ** 2) / 2 if within < np.inf else -np.inf
    d = sqrt(max(square - 2.0 * float(x[t.center[0]] @ q), 0.0))
    heap = [(d - float(t.radius[0]), 0, d)]
    while heap:
        bound, page, d = heappop(heap)
        if bound > within + room:
            break
        a, n, leaf = t.pages[page]
        b = a + n
        if leaf:
            may = np.abs(t.row_apart[a:b] - d) <= within + room
            many = int(np.count_nonzero(may))
            asked += many
            if not many:
                continue
            rows = None if many == n else np.flatnonzero(may) + a
            s = x[a:b] @ q if rows is None else x[rows] @ q
            hit = np.flatnonzero(s >= least)
            if not len(hit):
                continue
            rows, s = hit + a if rows is None else rows[hit], s[hit]
            if not (other := ids[rows] != own).all():
                rows, s = rows[other], s[other]
            if len(s) > k:
                hit = s >= np.partition(s, len(s) - k)[len(s) - k]
                rows, s = rows[hit], s[hit]
            best, score = np.concatenate((best, rows)), np.concatenate((score, s))
            if len(best) > k:
                keep = np.lexsort((ids[best], -score))[:k]
                best, score = best[keep], score[keep]
            if len(best) == k:
                least = float(score.min())
                within = min(within, sqrt(max(square - 2.0 * least, 0.0)))
            continue
        kids = np.flatnonzero(np.abs(t.apart[a:b] - d) - t.radius[a:b] <= within + room) + a
        asked += len(kids)
        away = np.sqrt(np.maximum(square - 2.0 * (x[t.center[kids]] @ q), 0.0))
        for bound, kid, far in zip((away - t.radius[kids]).tolist(), kids.tolist(), away.tolist(), strict=True):
            if bound <= within + room:
                heappush(heap, (bound, kid, far))
    return best, score.astype(np.int64), asked


TREE = ", ".join(f"{f.name} binary" for f in fields(Tree))
FOUND = "query_id long, vec_id long, score long, quid long, uid long, computed long"


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _raised(x: np.ndarray, longest: float) -> np.ndarray:
    """The rows with the further coordinate."""
    return np.column_stack((x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))))


def _pivots(v: DataFrame, n: int) -> np.ndarray:
    """n different vectors at most, from the SAMPLE rows of least hash."""
    x = _stack(v.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("vector").toPandas().vector)
    return (np.unique(x, axis=0) if x.shape[1] else x)[:: max(1, len(x) // n)][:n] if len(x) > n else x


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in four bytes each, or in eight if need be."""
    return x.astype(np.int32 if np.abs(x).max(initial=0) < 2**31 else np.int64).tobytes()


def _unpacked(b: bytes, rows: int, n: int) -> np.ndarray:
    return np.frombuffer(b, np.int32 if len(b) == 4 * rows * n else np.int64).reshape(rows, n).astype(np.float64)


def _distances(batches: Iterator[pd.DataFrame], pivots: np.ndarray, longest: float, raised: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    routing = _raised(pivots, longest)
    for b in batches:
        if not len(b):
            continue
        x = _stack(b.vector)
        x = _raised(x, longest) if raised else np.column_stack((x, np.zeros(len(x))))
        yield b, np.sqrt(np.maximum(((x[:, None] - routing[None]) ** 2).sum(2), 0.0))


def _by_bytes(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def index(v: DataFrame, pivots: np.ndarray, longest: float, chunk: int, leaf: int) -> DataFrame:
    """A row a chunk: its routing object and covering radius, its rows' ids and vectors, and the pages of their tree."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, d in _distances(_by_bytes(batches), pivots, longest, True):
            yield b.assign(pivot=d.argmin(1).astype(np.int32))

    routed = materialize(v.mapInPandas(route, "uid long, vec_id long, vector array<bigint>, pivot int"), "metric-rows")
    chunks = routed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))  # at most PIVOTS rows
    dealt = routed.join(F.broadcast(chunks), "pivot").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("uid", kind="stable")
        x = _raised(_stack(p.vector), longest)
        t = build(x, leaf)
        radius = np.sqrt(((x - _raised(pivots[int(p["pivot"].iloc[0])][None], longest)) ** 2).sum(1)).max()
        held = {"pivot": int(p["pivot"].iloc[0]), "part": int(p.part.iloc[0]), "reach": float(radius), "uids": p.uid.to_numpy()[t.rows].tobytes(), "ids": p.vec_id.to_numpy()[t.rows].tobytes(), "vectors": _packed(x[t.rows, :-1])}
        return pd.DataFrame([held | t.pack()])

    pages = materialize(dealt.groupBy("pivot", "part").applyInPandas(one, f"pivot int, part int, reach double, uids binary, ids binary, vectors binary, {TREE}"), "metric")
    discard(routed)
    return pages


def _visit(pages: DataFrame, pairs: DataFrame, longest: float, k: int) -> DataFrame:
    """The k best rows of each (query, chunk) pair of ``pairs``; queries come in blocks, a chunk goes to the blocks that ask for it."""
    key = ["pivot", "part", "block"]
    blocks = pairs.groupBy(*[F.col(c).alias(f"at_{c}") for c in key]).agg(F.count(F.lit(1)).alias("asks"))
    held = blocks.join(pages, (F.col("at_pivot") == F.col("pivot")) & (F.col("at_part") == F.col("part"))).drop("pivot", "part")

    def one(chunk: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(chunk) and len(asked):
            row = chunk.iloc[0]
            t, ids, uids = Tree.unpack(row), np.frombuffer(row.ids, np.int64), np.frombuffer(row.uids, np.int64)
            x = _unpacked(row.vectors, len(ids), len(asked.vector.iloc[0]))
            for q in asked.itertuples():
                vector = np.asarray(q.vector, np.float64)
                square = float(vector @ vector) + longest
                rows, score, computed = nearest(t, x, ids, vector, q.vec_id, square, k, q.within, square**0.5)
                out += [(q.vec_id, int(ids[r]), int(s), q.uid, int(uids[r]), computed) for r, s in zip(rows, score, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "quid", "uid", "computed"]).astype("int64")

    return held.groupBy(*[f"at_{c}" for c in key]).cogroup(pairs.groupBy(*key)).applyInPandas(one, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows; a row found for several vectors of one query id counts once, at its highest score."""
    found = found.groupBy("query_id", "uid", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, chunk: int = CHUNK, query_block: int = QUERY_BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of other ids with the greatest integer inner product.

    Both tables have vec_id and vector (array of longs whose squared length fits a long, see ``fixed_point``).  Rows whose id or vector
    is null take no part.  Vectors meet those of their own length only; empty ones score 0.  Rows
    that repeat an id are one candidate each, and never of a query of that id; queries that repeat an id
    are one query, each candidate at its highest score.  Ties go to the smaller vec_id; fewer
    candidates than k are all returned; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    usable = lambda t: t.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<bigint>")).where("vec_id is not null and vector is not null and not exists(vector, x -> x is null)")
    v = usable(vectors).withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "vector")
    q = usable(queries).distinct()
    out = spark.createDataFrame([], FOUND)
    lengths = v.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(_squares("vector")).alias("longest")).collect()  # a row for each length there is
    for n, rows, longest in sorted(tuple(r) for r in lengths):
        out = out.union(_search(v.where(F.size("vector") == n), q.where(F.size("vector") == n), rows, longest, k, chunk, query_block, leaf))
    return _best(out, k)


def _search(v: DataFrame, q: DataFrame, rows: int, longest: float, k: int, chunk: int, query_block: int, leaf: int) -> DataFrame:
    pivots = _pivots(v, min(PIVOTS, -(-rows // chunk)))
    pages = index(v, pivots, longest, chunk, leaf)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, d in _distances(_by_bytes(batches), pivots, longest, False):
            yield b.assign(away=list(d))

    q = q.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "vector")
    q = materialize(q.mapInPandas(route, "uid long, vec_id long, vector array<bigint>, away array<double>"), "metric-queries")
    blocks = max(1, -(-q.count() // query_block))
    q = q.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    directory = pages.select("pivot", "part", "reach")
    bounds = q.select("uid", F.posexplode("away").alias("pivot", "d")).join(directory, "pivot").select("uid", "pivot", "part", (F.col("d") - F.col("reach")).alias("bound"))
    asks = q.select("uid", "vec_id", "vector", "block")
    first = bounds.groupBy("uid").agg(F.min(F.struct("bound", "pivot", "part")).alias("b")).select("uid", "b.pivot", "b.part")
    begun = materialize(_visit(pages, asks.join(first, "uid").withColumn("within", F.lit(float("inf"))), longest, k), "metric-first")
    # a query that has k rows needs no chunk whose ball lies beyond the last of them
    length = _squares("vector") + longest
    got = begun.groupBy(F.col("quid").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    within = F.when(F.col("n") >= k, F.sqrt(F.greatest(length - 2.0 * F.col("least"), F.lit(0.0)))).otherwise(float("inf"))
    limits = asks.join(got, "uid", "left").withColumn("within", F.coalesce(within, F.lit(float("inf"))) + SLACK * F.sqrt(length)).drop("n", "least")
    rest = bounds.join(first, ["uid", "pivot", "part"], "left_anti").join(limits, "uid").where(F.col("bound") <= F.col("within"))
    return begun.union(_visit(pages, rest.drop("bound"), longest, k))
