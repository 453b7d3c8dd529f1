"""Ranking, folds over time, blocks, gaps and transitions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.functions import geometry as G
from fusegrid.functions import model as M
from fusegrid.plans.scratch import materialize


def ranked_components(scored: DataFrame, keys: Sequence[str] = ("frame", "det")) -> DataFrame:
    """Components ranked by (score, -n, label), with the margin of the second over the first at rank 1."""
    w = W.partitionBy(*keys).orderBy("score", F.desc("n"), "label")
    r = scored.where("score is not null").withColumns({"rnk": F.row_number().over(w), "_next": F.lead("score").over(w)})
    return r.withColumn("margin", F.when(F.col("rnk") == 1, F.col("_next") - F.col("score"))).withColumn("ambiguous", F.coalesce(F.col("margin") < 0.05, F.lit(False))).drop("_next")


def ewma_velocity(rows: DataFrame, key: str, t: str, x: str, per: float = 1.0) -> DataFrame:
    """Final (n, velocity) of each key: v = .72 v + .28 dx/dt over the rows in time order, skipping steps of no time.

    The recursion in closed form: step e of E counts .28 * .72 ** (E - e), so a key is a sorted stream and no array.
    """
    w = W.partitionBy(key).orderBy("_t", "_x")
    d = rows.select(key, F.col(t).cast("double").alias("_t"), F.col(x).cast("double").alias("_x"))
    d = d.withColumns({"_dt": (F.col("_t") - F.lag("_t").over(w)) / per, "_dx": F.col("_x") - F.lag("_x").over(w)})
    d = d.withColumn("_r", F.when(F.col("_dt") > 1e-6, F.col("_dx") / F.col("_dt")))
    d = d.withColumns({"_e": F.count("_r").over(w.rowsBetween(W.unboundedPreceding, 0)), "_all": F.count("_r").over(W.partitionBy(key))})
    part = F.col("_r") * F.pow(F.lit(M.EWMA_KEEP), F.col("_all") - F.col("_e")) * M.EWMA_NEW
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0.0)).alias("velocity"))


def monotonic(rows: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Whether ``value`` strictly increases in ``order`` within each key."""
    w = W.partitionBy(*key).orderBy(order)
    d = rows.withColumn("_up", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True)))
    return d.groupBy(*key).agg(F.bool_and("_up").alias("strictly_increasing"))


def ring_edges(points: DataFrame, keys: Sequence[str] = ("frame",), row: str = "pid") -> DataFrame:
    """Points at a jump in range between neighbours of a scan ring.

    Ranges of 1 to 18 m; rings of four points or more; neighbours .01 to .45 degrees apart
    whose ranges differ by more than max(.25, .045 * the nearer range).
    """
    rng, azimuth, elevation = G.spherical("x", "y", "z")
    p = points.where(G.finite("x", "y", "z")).withColumns({"range": rng, "azimuth": azimuth, "elevation": elevation}).where("range between 1 and 18")
    k, near = G.ring("elevation")
    p = p.withColumn("ring", k).where(near)
    w = W.partitionBy(*keys, "ring").orderBy("azimuth", row)
    p = p.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys, "ring"))).where("_n >= 4")

    def jump(a, r):
        gap, step = F.abs(a - F.col("azimuth")), F.abs(r - F.col("range"))
        return F.coalesce((gap > 0.01) & (gap < 0.45) & (step > F.greatest(F.lit(0.25), F.least(r, F.col("range")) * 0.045)), F.lit(False))

    back = jump(F.lag("azimuth").over(w), F.lag("range").over(w))
    ahead = jump(F.lead("azimuth").over(w), F.lead("range").over(w))
    return p.withColumn("_edge", back | ahead).where("_edge").drop("_edge", "_n")


def equal_blocks(rows: DataFrame, keys: Sequence[str], order: str, n: int = 4) -> DataFrame:
    """Chronological blocks from 1, the first ones a row longer where sizes differ."""
    return rows.withColumn("block", F.ntile(n).over(W.partitionBy(*keys).orderBy(order)))


def ceil_blocks(rows: DataFrame, keys: Sequence[str], order: str, n: int = 4) -> DataFrame:
    """Chronological blocks of ceil(count / n) rows, the last one short."""
    w = W.partitionBy(*keys)
    k = F.floor((F.row_number().over(w.orderBy(order)) - 1) / F.ceil(F.count(F.lit(1)).over(w) / n)) + 1
    return rows.withColumn("block", F.least(k, F.lit(n)).cast("int"))


def transitions(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the key's previous one."""
    d = rows.withColumn("previous", F.lag(value).over(W.partitionBy(key).orderBy(order)))
    return d.where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def even_sample(rows: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """k rows of each key at evenly spaced places, first and last included, half-even rounding; all if there are fewer."""
    w = W.partitionBy(*keys)
    d = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.rint(j * (F.col("_n") - 1).cast("double") / float(max(k - 1, 1))).cast("int"))
    return d.where((F.col("_n") <= k) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def even_sample_of_all(rows: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """``even_sample`` of a whole table, whose order must not tie: places by ranges of the order, then an equi-join with the k that are taken."""
    held = running_total(rows.withColumn("_one", F.lit(1)), [], order, "_one", "_n")
    n = held.agg(F.count(F.lit(1)).alias("n"))
    j = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    taken = n.select("n", j.alias("j")).select(F.when(F.col("n") <= k, F.col("j")).otherwise(F.rint(F.col("j") * (F.col("n") - 1).cast("double") / float(max(k - 1, 1)))).cast("long").alias("_i")).distinct()
    return held.withColumn("_i", F.col("_n") - 1).join(F.broadcast(taken), "_i").select(*rows.columns)


def run_counts(rows: DataFrame, key: str, frame: str, x: str, y: str, gate: float = 0.88) -> DataFrame:
    """``seed_count``: consecutive frames up to each row whose steps stay within the gate."""
    w = W.partitionBy(key).orderBy(frame)
    goes_on = (F.col(frame) == F.lag(frame).over(w) + 1) & (F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) <= gate)
    d = rows.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(w))
    return d.withColumn("seed_count", F.row_number().over(W.partitionBy(key, "_run").orderBy(frame))).drop("_new", "_run")


def gap_fill(rows: DataFrame, key: str, frame: str) -> DataFrame:
    """A row for every frame between a key's first and last, nulls where there was none, and ``observed``."""
    grid = rows.groupBy(key).agg(F.min(frame).alias("_a"), F.max(frame).alias("_b")).select(key, F.explode(F.sequence("_a", "_b")).alias(frame))
    return grid.join(rows.withColumn("observed", F.lit(True)), [key, frame], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def first_report(rows: DataFrame, key: str, order: str, measured: str) -> DataFrame:
    """``state_source``: LIDAR_MEASUREMENT at a measurement's first report, CAUSAL_PREDICTION after."""
    n = F.row_number().over(W.partitionBy(key, measured).orderBy(order))
    return rows.withColumn("state_source", F.when(n == 1, "LIDAR_MEASUREMENT").otherwise("CAUSAL_PREDICTION"))


def track_lifetimes(rows: DataFrame, key: str, frame: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(frame).alias("birth"), F.max(frame).alias("last"), (F.max(frame) - F.min(frame) + 1).alias("lifetime"))


def running_rate(rows: DataFrame, keys: Sequence[str], t: str, per: float) -> DataFrame:
    """Rows so far over the time since the first, null at the first."""
    w = W.partitionBy(*keys).orderBy(t)
    n = F.row_number().over(w)
    elapsed = (F.col(t) - F.first(t).over(w)) / per
    return rows.withColumn("rate", F.when(elapsed > 0, (n - 1) / elapsed))


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def kept_boxes(detections: DataFrame, keys: Sequence[str] = ("frame",), conf: float = 0.3, overlap: float = 0.6, most: int = 12) -> DataFrame:
    """Greedy suppression in confidence order, then the ``most`` best: a fold over a frame's few boxes."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("c"), "det", "x1", "y1", "x2", "y2")))

    def overlaps(a, b):
        w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
        h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        area = lambda s: (s["x2"] - s["x1"]) * (s["y2"] - s["y1"])
        return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-9))

    g = detections.where(F.col("conf") >= conf).groupBy(*keys).agg(order.alias("all"))
    none = F.filter("all", lambda s: F.lit(False))
    g = g.withColumn("kept", F.aggregate("all", none, lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s) > overlap), kept).otherwise(F.concat(kept, F.array(s)))))
    return g.select(*keys, F.explode(F.slice("kept", 1, most)).alias("s")).select(*keys, "s.det", (-F.col("s.c")).alias("conf"), "s.x1", "s.y1", "s.x2", "s.y2")


def running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows with the sum of ``value`` up to and with each, in a key's order, which must not tie.

    Rows are dealt by ranges of (keys, order) and written; a range starts from the sums of the
    key's earlier ranges, of which there is one row each.  So a key may hold any share of the rows.
    """
    by = [*keys, *order]
    held = materialize(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = held.groupBy(*keys, "_part").agg(F.sum(value).alias("_s"))
    before = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (F.sum("_s").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_s")).alias("_b"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    here = F.sum(value).over(W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return held.withColumn("_h", here).join(before, same).select(*rows.columns, (F.col("_h") + F.col("_b")).alias(name))


def indexed(events: DataFrame, topic: str, arrival: Sequence[str], limit: int | None = None) -> DataFrame:
    """Events with ``idx``: their 0-based number within the topic in arrival order, which must not tie; those from ``limit`` on are left out."""
    d = running_total(events.withColumn("_one", F.lit(1)), [topic], arrival, "_one", "_n").select(*events.columns, (F.col("_n") - 1).alias("idx"))
    return d if limit is None else d.where(F.col("idx") < limit)


def backlog_drops(frames: DataFrame, keys: Sequence[str], due: str, cost: str, limit: float) -> DataFrame:
    """``processed``: whether a frame is worked on by one worker that drops what is more than ``limit`` late.

    The worker's free time depends on what it dropped before, so a task streams its keys' frames in order, and holds that time only.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, free = None, -inf
        for p in parts:
            taken = []
            for *key, at, work in p.itertuples(index=False, name=None):
                if key != of:
                    of, free = key, -inf
                taken.append(free - at <= limit)
                if taken[-1]:
                    free = max(free, at) + work
            yield p[[*keys, due]].assign(processed=taken)

    types = dict(frames.dtypes)
    d = frames.select(*keys, F.col(due).cast("double").alias(due), F.col(cost).cast("double").alias(cost))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {due} double, processed boolean"
    return d.repartition(*keys).sortWithinPartitions(*keys, due, cost).mapInPandas(run, schema)


def token_rank(column: str, tokens: Sequence[str]) -> Column:
    """The place of the first token that a text holds; their number without any."""
    out = F
    for i, t in enumerate(tokens):
        out = out.when(F.contains(F.col(column), F.lit(t)), i)
    return out.otherwise(len(tokens))


def stride(rows: DataFrame, index: str, step: int) -> DataFrame:
    """Every ``step``-th row by an index: a sampling operator that does not depend on partitions."""
    return rows.where(F.col(index) % step == 0)


def of_class(detections: DataFrame, names: Mapping[int, str], name: str, class_id: str) -> DataFrame:
    """The detections of the one class of that name; raises unless exactly one has it."""
    ids = [i for i, n in names.items() if n == name]
    if len(ids) != 1:
        raise ValueError(f"{len(ids)} classes are named {name}")
    return detections.where(F.col(class_id) == ids[0])
