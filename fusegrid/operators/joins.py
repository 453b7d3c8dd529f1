"""As-of, nearest, range, radius and containment joins.

All are equi-joins on a frame, cell or time bucket with residual predicates, or
windows; none is a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.functions import boxes as B
from fusegrid.functions import geometry as G
from fusegrid.functions import model as M
from fusegrid.plans.scratch import materialize


def asof_backward(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tolerance: int | None, by: Sequence[str] = ()) -> DataFrame:
    """Each left row with the latest right row at or before it, within ``tolerance`` (bounds included).

    Both sides go through one window per key, so the cost is one sort.  Right columns must
    differ from the left's, but for the keys.  ``by`` names a partitioning key;
    ``bucketed_asof`` and ``asof_latest`` serve long series of one key.
    """
    if not by:
        raise ValueError("an as-of join without a key puts all rows in one task; take bucketed_asof or asof_latest")
    keys = list(by)
    carried = F.struct(*[F.col(c) for c in right.columns if c not in keys])
    rows = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*[c for c in left.columns if c not in keys]).alias("_l"))
    rows = rows.unionByName(right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), carried.alias("_r")), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1 and _r is not null")
    out = out.select(*keys, "_l.*", "_r.*")
    return out if tolerance is None else out.where(F.col(left_ts) - F.col(right_ts) <= tolerance)


def bucketed_asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tolerance: int, by: Sequence[str] = ()) -> DataFrame:
    """``asof_backward`` for one long series: time buckets of the tolerance's length, right rows also in the next bucket.

    A match lies in the left row's bucket or the one before, so buckets are independent.
    """
    right = right.withColumn("_b", F.explode(F.array(F.floor(F.col(right_ts) / tolerance), F.floor(F.col(right_ts) / tolerance) + 1)))
    left = left.withColumn("_b", F.floor(F.col(left_ts) / tolerance))
    return asof_backward(left, right, left_ts, right_ts, tolerance, [*by, "_b"]).drop("_b")


def nearest_timestamp(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, reach: int, by: Sequence[str] = ()) -> DataFrame:
    """Each left row with the closer of its neighbours in time (right columns) within ``reach`` (bounds included), ties to the earlier.

    No pairs are made: rows meet in buckets of a 24th of the reach, where running minima give the right rows before and
    after; what a bucket takes from others is found on one row a bucket.  Of right rows of one time the one with the least columns counts.
    """
    keys, width = list(by), max(reach // 24, 1)
    carried = [c for c in right.columns if c not in keys]
    rows = left.where(F.col(left_ts).isNotNull()).select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*[c for c in left.columns if c not in keys]).alias("_l"))
    here = F.struct(*carried)
    held = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct((-F.col(right_ts)).alias("k"), here.alias("r")).alias("_past"), F.struct(F.col(right_ts).alias("k"), here.alias("r")).alias("_next"))
    rows = rows.unionByName(held, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    ends = rows.groupBy(*keys, "_b").agg(F.min("_past").alias("_past"), F.min("_next").alias("_next"))
    w = W.partitionBy(*keys)
    over = ends.select(*keys, "_b", F.min("_past").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.min("_next").over(w.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)).alias("_after"))
    w = W.partitionBy(*keys, "_b")
    rows = rows.withColumn("_past", F.min("_past").over(w.orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_next", F.min("_next").over(w.orderBy(F.desc("_t"), "_side").rowsBetween(W.unboundedPreceding, 0))).where("_side = 1")
    same = reduce(Column.__and__, [rows[c].eqNullSafe(over[c]) for c in keys], rows["_b"] == over["_b"])
    rows = rows.join(over, same).select(*[rows[c] for c in keys], "_t", "_l", F.coalesce("_past", "_before").alias("_past"), F.coalesce("_next", "_after").alias("_next"))
    ago, ahead = F.col("_t") + F.col("_past.k"), F.col("_next.k") - F.col("_t")
    rows = rows.withColumns({"_r": F.when(F.coalesce(ago <= ahead, F.col("_past").isNotNull()), F.col("_past.r")).otherwise(F.col("_next.r")), "_d": F.least(ago, ahead)})
    return rows.where(F.col("_d") <= reach).select(*keys, "_l.*", "_r.*")


def voxel_flag(points: DataFrame, voxels: DataFrame, keys: Sequence[str] = ("kx", "ky", "kz"), name: str = "in_prior") -> DataFrame:
    """Points with whether their voxel is in the prior; drop the flagged ones for the anti-join."""
    return points.join(voxels.select(*keys, F.lit(True).alias(name)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def voxel_antijoin(points: DataFrame, voxels: DataFrame, keys: Sequence[str] = ("kx", "ky", "kz")) -> DataFrame:
    return points.join(voxels, list(keys), "left_anti")


def near_flag(points: DataFrame, places: DataFrame, radius: float, name: str = "near", x: str = "x", y: str = "y", px: str = "ox", py: str = "oy") -> DataFrame:
    """Points with whether any place is within ``radius``: cells of the radius, different places posted in their 3x3 neighbourhood.

    An existence join: a point keeps its task if the places are few, and stops at the first place that is near.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    posted = small(places.select(F.col(px).alias("_px"), F.col(py).alias("_py")).distinct())
    for name_, c in (("_qx", "_px"), ("_qy", "_py")):
        posted = posted.withColumn(name_, F.explode(F.array(*[cell(c) + i for i in (-1, 0, 1)])))
    at = lambda c: F.col(c).outer()
    near = (F.pow(at(x) - F.col("_px"), 2) + F.pow(at(y) - F.col("_py"), 2)) <= radius * radius
    p = G.bound(points, _cx=cell(x), _cy=cell(y))  # the optimizer can't push an existence test below a union
    return p.withColumn(name, posted.where((F.col("_qx") == at("_cx")) & (F.col("_qy") == at("_cy")) & near).exists()).drop("_cx", "_cy")


def near_any(points: DataFrame, places: DataFrame, radius: float, x: str = "x", y: str = "y", px: str = "ox", py: str = "oy") -> DataFrame:
    """The points within ``radius`` of any place."""
    return near_flag(points, places, radius, "_near", x, y, px, py).where("_near").drop("_near")


def owners(points: DataFrame, detections: DataFrame, keys: Sequence[str] = ("frame",), point: str = "pid") -> DataFrame:
    """Exclusive owner of each point: the box of least centre distance among those that contain it, ties to the lower det."""
    b = B.box("")
    pair = points.join(detections, list(keys)).where(B.inside("u", "v", b))
    pair = pair.withColumn("own_score", B.center_distance("u", "v", b))
    w = W.partitionBy(*keys, point).orderBy("own_score", "det")
    return pair.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_owner(points: DataFrame, detections: DataFrame, owned: Column, keys: Sequence[str] = ("frame",), point: str = "pid") -> DataFrame:
    """A row for each point and box that contains it, with the ``owner`` of ``owners`` among those boxes; null for points that are not ``owned``."""
    b = B.box("")
    pair = points.join(detections, list(keys)).where(B.inside("u", "v", b)).withColumn("_s", B.center_distance("u", "v", b))
    w = W.partitionBy(*keys, point).orderBy("_s", "det").rowsBetween(W.unboundedPreceding, 0)
    return pair.withColumn("owner", F.when(owned, F.first("det").over(w))).drop("_s")


def soft_owners(points: DataFrame, detections: DataFrame, margins: DataFrame, keys: Sequence[str] = ("frame",), point: str = "pid") -> DataFrame:
    """Owners under each side margin of ``margins`` (a small parameter table)."""
    pair = points.join(detections, list(keys)).crossJoin(F.broadcast(margins))
    pair = pair.withColumn("own_cost", B.soft_cost("u", "v", B.box(""), "margin")).where("own_cost is not null")
    w = W.partitionBy("margin", *keys, point).orderBy("own_cost", "det")
    return pair.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def containing(centers: DataFrame, detections: DataFrame, keys: Sequence[str] = ("frame",), row: str = "cid") -> DataFrame:
    """How many boxes of its frame contain each centre."""
    hit = centers.join(detections, list(keys)).where(B.inside("u", "v", B.box("")))
    n = hit.groupBy(*keys, row).agg(F.count(F.lit(1)).alias("n_boxes"))
    return centers.join(n, [*keys, row], "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))


def nearest_other(rows: DataFrame, keys: Sequence[str], row: str, x: str = "x", y: str = "y") -> DataFrame:
    """Distance of each row to the nearest other row of its group; null if it is alone."""
    other = rows.select(*keys, F.col(row).alias("_o"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    d = rows.join(other, list(keys)).where(F.col(row) != F.col("_o")).groupBy(*keys, row).agg(F.min(F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))).alias("nearest"))
    return rows.join(d, [*keys, row], "left")


def nearest_k(rows: DataFrame, keys: Sequence[str], row: str, k: int, radius: float, x: str = "u", y: str = "v") -> DataFrame:
    """(row, neighbour, distance, rank): the k nearest others within ``radius``.

    Rows meet over cells of three times the radius; a neighbour is posted in further cells only if it lies within the radius of their border.
    """
    cell = lambda c: F.floor(F.col(c) / (radius * 3)).cast("long")
    left = rows.withColumns({"_cx": cell(x), "_cy": cell(y)})
    right = posted_cells(rows.select(*keys, F.col(row).alias("neighbour"), F.col(x).alias("_x"), F.col(y).alias("_y")), radius, "_x", "_y")
    pair = left.join(right, [*keys, "_cx", "_cy"]).withColumn("distance", G.length(F.col(x) - F.col("_x"), F.col(y) - F.col("_y")))
    pair = pair.where((F.col(row) != F.col("neighbour")) & (F.col("distance") <= radius))
    w = W.partitionBy(*keys, row).orderBy("distance", "neighbour")
    return pair.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, row, "neighbour", "distance", "rank")


def posted_cells(rows: DataFrame, radius: float, x: str, y: str) -> DataFrame:
    """Rows with each cell (_cx, _cy) of three times the radius that holds any place within the radius of theirs."""
    reach = radius * 1.001  # a little more, so that no rounding at a border loses a neighbour
    for name, c in (("_cx", F.col(x)), ("_cy", F.col(y))):
        rows = rows.withColumn(name, F.explode(F.sequence(*[F.floor(e / (radius * 3)).cast("long") for e in (c - reach, c + reach)])))
    return rows


def nearest_of(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, other: str, k: int, radius: float, x: str = "u", y: str = "v") -> DataFrame:
    """(keys, row, other, distance, rank): the k nearest right rows of each left row, however far.

    Rings of cells: a round takes the rows within the radius, over cells of it; a left row with k of them is done, as
    all others lie farther; the rest go on with twice the radius, until it spans both sides of their
    keys, and then have all that there are.  So crowded places are searched over small cells only, and the few rows in
    empty ones over large cells.  ``row`` names a left row within its keys.  Ties go to the smaller ``other``; coordinates that are null or not finite take no part.
    """
    whole = lambda d: d.where(F.abs(x) < float("inf")).where(F.abs(y) < float("inf"))
    points = whole(right).select(*keys, F.col(other), F.col(x).alias("_x"), F.col(y).alias("_y"))
    rest, found = whole(left).select(*keys, row, x, y), []
    both = rest.select(*keys, x, y).unionByName(points.select(*keys, F.col("_x").alias(x), F.col("_y").alias(y)))
    spans = both.groupBy(*keys).agg(F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("_span"))
    rest = materialize(rest.join(spans, list(keys)), "nearest-rest")
    while not rest.isEmpty():
        cell = lambda c, r=radius: F.floor(F.col(c) / r).cast("long")
        near = points
        for name, c in (("_cx", "_x"), ("_cy", "_y")):
            near = near.withColumn(name, F.explode(F.array(*[cell(c) + i for i in (-1, 0, 1)])))
        pair = rest.withColumns({"_cx": cell(x), "_cy": cell(y)}).join(near, [*keys, "_cx", "_cy"]).withColumn("distance", G.length(F.col(x) - F.col("_x"), F.col(y) - F.col("_y")))
        w = W.partitionBy(*keys, row).orderBy("distance", other)
        best = pair.where(F.col("distance") <= radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        best = materialize(best.select(*keys, row, other, "distance", "rank", "_span"), "nearest-best")
        done = best.groupBy(*keys, row).agg(F.max("rank").alias("_n"), F.first("_span").alias("_span")).where((F.col("_n") >= k) | (F.col("_span") <= radius)).select(*keys, row)
        found.append(best.join(done, [*keys, row], "left_semi").drop("_span"))
        rest = materialize(rest.where(F.col("_span") > radius).join(done, [*keys, row], "left_anti"), "nearest-rest")
        radius *= 2
    return reduce(DataFrame.union, found) if found else best_of_none(left, right, keys, row, other)


def best_of_none(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, other: str) -> DataFrame:
    """The columns of ``nearest_of`` without a row."""
    return left.join(right.select(*keys, other), list(keys)).where(F.lit(False)).select(*keys, row, other, F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))


def nearest_box(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, limit: float = 1e-6) -> DataFrame:
    """The right box of least greatest coordinate difference for each left box, and whether it is within the limit.  Boxes: l_* and r_*."""
    gap = F.greatest(*[F.abs(F.col(f"l_{k}") - F.col(f"r_{k}")) for k in ("x1", "y1", "x2", "y2")])
    pair = left.join(right, list(keys)).withColumn("gap", gap)
    best = pair.groupBy(*keys, row).agg(F.min(F.struct("gap", F.col("r_det"))).alias("b"))
    return best.select(*keys, row, F.col("b.gap").alias("gap"), F.col("b.r_det").alias("r_det"), (F.col("b.gap") <= limit).alias("same"))


def best_candidate(centers: DataFrame, detections: DataFrame, keys: Sequence[str] = ("frame",), row: str = "cid", proxy: str = "p_") -> DataFrame:
    """The detection that contains the centre or overlaps its proxy box by .1, by (contains, IoU, distance, det)."""
    b, p = B.box(""), B.box(proxy)
    pair = centers.join(detections, list(keys))
    pair = pair.withColumns({"contains": B.inside("u", "v", b), "iou": B.iou(p, b), "distance": F.hypot(F.col("u") - (b[0] + b[2]) / 2, F.col("v") - (b[1] + b[3]) / 2)})
    pair = pair.where(F.col("contains") | (F.col("iou") >= 0.1))
    w = W.partitionBy(*keys, row).orderBy(F.desc("contains"), F.desc("iou"), "distance", "det")
    return pair.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def adaptive_edges(points: DataFrame, keys: Sequence[str] = ("frame", "det"), row: str = "pid") -> DataFrame:
    """Links i < j with distance at most the radius of point i, ``.18 + .02 * range``.

    Points meet over grid cells of the largest radius in use, so a crowded group is not joined with itself whole.
    """
    a, b = M.COMPONENT_RADIUS
    r = points.withColumn("_r", G.length(F.col("x"), F.col("y")) * b + a)
    # cells of half a metre cover ranges to 16 m; farther groups take the size their range needs
    size = F.greatest(F.lit(0.5), F.ceil(F.max("_r").over(W.partitionBy(*keys)) * 2) / 2)
    r = r.withColumn("_s", size)
    for name, c in (("_cx", "x"), ("_cy", "y"), ("_cz", "z")):
        r = r.withColumn(name, F.floor(F.col(c) / F.col("_s")).cast("long"))
    other = r.select(*keys, F.col(row).alias("j"), *[F.col(c).alias(f"_{c}") for c in "xyz"], "_cx", "_cy", "_cz")
    for name in ("_cx", "_cy", "_cz"):
        other = other.withColumn(name, F.explode(F.array(*[F.col(name) + i for i in (-1, 0, 1)])))
    d2 = sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in "xyz"), F.lit(0.0))
    pair = r.join(other, [*keys, "_cx", "_cy", "_cz"]).where((F.col(row) < F.col("j")) & (F.sqrt(d2) <= F.col("_r")))
    return pair.select(*keys, F.col(row).alias("i"), "j")


def union_schemas(*frames: DataFrame) -> DataFrame:
    """All rows under the union of the columns, in first-seen order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def null_safe_mismatches(a: DataFrame, b: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row: joined, left-only and right-only keys and, for each field, how many joined rows differ."""
    x = a.select(*key, *[F.col(f).alias(f"l_{f}") for f in fields], F.lit(True).alias("_l"))
    y = b.select(*key, *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(True).alias("_r"))
    j = x.join(y, list(key), "full_outer")
    both: Column = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    counts = [F.count_if(both & ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))).alias(f"{f}_mismatches") for f in fields]
    return j.agg(F.count_if(both).alias("joined"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), *counts)


def asof_latest(left: DataFrame, right: DataFrame, width: int = 3_600_000_000, carry: Sequence[str] = ()) -> DataFrame:
    """Each left row (idx, ts) with the latest right row at or before it, however old: its ``age`` and columns ``carry``.

    Rows meet in buckets of time; what a bucket takes over from earlier ones is found on one
    row a bucket, so one long series is spread over tasks.  Left rows without any are left out;
    of right rows of one time the one with the greatest carried columns counts.
    """
    bucket = F.floor(F.col("ts") / width).alias("bucket")
    held = F.struct("ts", *carry)
    rows = left.select(bucket, "ts", "idx", F.lit(1).alias("side")).unionByName(right.select(bucket, "ts", F.lit(0).alias("side"), held.alias("right")), allowMissingColumns=True)
    last = rows.groupBy("bucket").agg(F.max("right").alias("last"))
    over = last.select("bucket", F.max("last").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    w = W.partitionBy("bucket").orderBy("ts", "side").rowsBetween(W.unboundedPreceding, 0)
    here = rows.withColumn("here", F.max("right").over(w)).where("side = 1")
    found = here.join(over, "bucket").withColumn("found", F.coalesce("here", "before")).where("found is not null")
    return found.select("idx", "ts", (F.col("ts") - F.col("found.ts")).alias("age"), *[F.col(f"found.{c}").alias(c) for c in carry])


def small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """The rows, to be broadcast if there are ``most`` at most; beyond that Spark decides."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
