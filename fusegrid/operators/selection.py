"""Exact quantiles of groups of any size, by selection over ranges of values.

Each wanted rank has a range that holds it, at first its group's least to greatest value.  A round counts the values of
every range in BUCKETS equal parts, with each part's own least and greatest value, and goes on with the part that holds the
rank, until one value is left.  What is shuffled and held is a few counts a range: the values are read, never gathered
or sorted, and a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.operators.joins import small
from fusegrid.plans.scratch import materialize

BUCKETS = 4096


def _part(x: str, lo: str, hi: str) -> Column:
    """The part of [lo, hi] that holds x: increasing in x, 0 for lo and the last for hi, so that a round always splits a range.  Halves, as hi - lo may exceed a double."""
    share = (F.col(x) / 2 - F.col(lo) / 2) / (F.col(hi) / 2 - F.col(lo) / 2)
    inner = F.coalesce(F.floor(F.nanvl(share, F.lit(1.0 / BUCKETS)) * BUCKETS), F.lit(1))
    return F.when(F.col(x) <= F.col(lo), 0).when(F.col(x) >= F.col(hi), BUCKETS - 1).otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(BUCKETS - 1)))


def _values_at(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_k, r, value) for the ranks ``wanted`` (_k, r, lo, hi): the r-th least value of _k, from 0."""
    open_ = materialize(wanted.withColumn("below", F.lit(0).cast("long")), "ranks")
    found = []
    while True:
        found.append(open_.where("lo = hi").select("_k", "r", F.col("lo").alias("value")))
        left = open_.where("lo < hi")
        if left.isEmpty():
            return reduce(DataFrame.union, found)
        ranges = left.select("_k", "lo", "hi", "below").distinct()
        held = values.join(small(ranges), "_k").where("_x between lo and hi").withColumn("part", _part("_x", "lo", "hi"))
        counts = held.groupBy("_k", "lo", "hi", "below", "part").agg(F.count(F.lit(1)).alias("c"), F.min("_x").alias("a"), F.max("_x").alias("z"))
        counts = counts.withColumn("upto", F.col("below") + F.sum("c").over(W.partitionBy("_k", "lo", "hi").orderBy("part"))).drop("below")
        there = (F.col("r") >= F.col("upto") - F.col("c")) & (F.col("r") < F.col("upto"))
        open_ = materialize(left.drop("below").join(counts, ["_k", "lo", "hi"]).where(there).select("_k", "r", F.col("a").alias("lo"), F.col("z").alias("hi"), (F.col("upto") - F.col("c")).alias("below")), "ranks")


def quantiles(rows: DataFrame, x: str, at: Mapping[str, float], keys: Sequence[str] = (), more: Mapping[str, Column] | None = None) -> DataFrame:
    """The keys, n, a column for each of ``at`` (name: share) with that quantile, linearly interpolated, and the aggregates ``more`` over ``_x``.

    Nulls and NaN are left out; null keys are a group; groups without a value have no row.
    """
    values = rows.select(F.struct(*[F.col(k) for k in keys] or [F.lit(0).alias("all")]).alias("_k"), F.col(x).cast("double").alias("_x"))
    values = materialize(values.where(F.col("_x").isNotNull() & ~F.isnan("_x")), "values")
    groups = materialize(values.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), *[c.alias(name) for name, c in (more or {}).items()]), "groups")
    place = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in at.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    got = _values_at(values, groups.select("_k", "lo", "hi", F.explode(ranks).alias("r")))
    table = got.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("r", "value"))).alias("v"))  # two entries a quantile

    def between(p: Column) -> Column:
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        return F.when(low == high, F.col("v")[low]).otherwise((high - p) * F.col("v")[low] + (p - low) * F.col("v")[high])

    return groups.join(table, "_k").select(*[F.col(f"_k.{k}").alias(k) for k in keys], "n", *[between(p).alias(name) for name, p in place.items()], *(more or {}))
