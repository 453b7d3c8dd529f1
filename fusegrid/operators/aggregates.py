"""Aggregates: centres, distributions, metrics, priors, trends, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.functions import model as M
from fusegrid.operators.selection import quantiles
from fusegrid.operators.windows import running_total


def quantile(x: Column | str, p: float) -> Column:
    """Exact, linearly interpolated, for groups that fit a task, as a box's points; ``selection.quantiles`` serves any."""
    return F.percentile(x, F.lit(p))


def robust_center(x: str) -> Column:
    both = F.percentile(x, F.array(*map(F.lit, M.CENTER_QUANTILES)))  # one buffer for both
    return (both[0] + both[1]) / 2


def span(x: str) -> Column:
    return F.max(x) - F.min(x)


def timing_distribution(rows: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, p90, p95, p99, max of each group of any size."""
    return quantiles(rows, x, {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, keys, {"mean": F.avg("_x"), "max": F.max("_x")})


def error_distribution(rows: DataFrame, e: str, keys: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """n, rmse, p50, p95, max of each group of any size."""
    more = {"rmse": F.sqrt(F.avg(F.col("_x") * F.col("_x"))), "max": F.max("_x")}
    return quantiles(rows, e, {f"{prefix}p50": 0.5, f"{prefix}p95": 0.95}, keys, {prefix + k: c for k, c in more.items()})


def ratio(a: Column, b: Column) -> Column:
    """a over b, with b at least 1."""
    return a / F.greatest(b, F.lit(1))


def detection_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn columns."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, F.col("precision") * F.col("recall") * 2 / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def frequent_voxels(points: DataFrame, frame: str, keys: Sequence[str], share: float, least: int = 0, frames: int | None = None) -> DataFrame:
    """Voxels seen in at least ``max(least, ceil(share * frames))`` distinct frames, with their frame counts."""
    seen = points.select(frame, *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    if frames is not None:
        return seen.where(F.col("n_frames") >= F.greatest(F.lit(least), F.ceil(F.lit(share * frames))))
    total = points.agg(F.countDistinct(frame).alias("_f"))
    return seen.crossJoin(F.broadcast(total)).where(F.col("n_frames") >= F.greatest(F.lit(least), F.ceil(F.col("_f") * share))).drop("_f")


def _beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their group; null keys are a group."""
    if not keys:
        return rows.crossJoin(F.broadcast(groups))
    g = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in groups.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(g, same).drop(*[f"_k{i}" for i in range(len(keys))])


def _beside_left(groups: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All groups, with the columns of ``more`` where it has them; null keys are a group."""
    m = more.select(F.struct(*keys).alias("_k"), *[c for c in more.columns if c not in keys])
    return groups.withColumn("_k", F.struct(*keys)).join(m, "_k", "left").drop("_k")


def robust_limit(rows: DataFrame, x: str, keys: Sequence[str] = (), least: int = 100) -> DataFrame:
    """min(p99, max(median + 3 * 1.4826 * MAD, p90)) of each group of ``least`` values or more.

    Quantiles come by selection over ranges of values, so no task holds a group's values.
    """
    g = quantiles(rows, x, {"median": 0.5, "p90": 0.9, "p99": 0.99}, keys).where(F.col("n") >= least)
    off = _beside(rows.select(*keys, x), g.select(*keys, F.col("median").alias("_m")), keys).withColumn("_off", F.abs(F.col(x) - F.col("_m")))
    return _beside(g, quantiles(off, "_off", {"mad": 0.5}, keys).drop("n"), keys).withColumn("limit", F.least("p99", F.greatest(F.col("median") + F.col("mad") * (3 * 1.4826), F.col("p90"))))


def winsorized_mean(rows: DataFrame, x: str, keys: Sequence[str], least: int = 8, default: float = 30.0) -> DataFrame:
    """Twice the mean of the values cut at their 90th percentile; ``default`` for groups of fewer than ``least``."""
    cut = quantiles(rows, x, {"_c": 0.9}, keys).drop("n")
    return _beside(rows.select(*keys, x), cut, keys).groupBy(*keys).agg(F.when(F.count(F.lit(1)) < least, default).otherwise(F.avg(F.least(F.col(x), F.col("_c"))) * 2.0).alias("score"))


def linear_fit(y: str, x: str, least: int = 3) -> list[Column]:
    """n, r, slope, intercept, r2; all but n null with fewer than ``least`` rows or without variance."""
    ok = (F.count(F.lit(1)) >= least) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return [F.count(F.lit(1)).alias("n"), F.when(ok, F.corr(y, x)).alias("r"), F.when(ok, F.regr_slope(y, x)).alias("slope"), F.when(ok, F.regr_intercept(y, x)).alias("intercept"), F.when(ok, F.regr_r2(y, x)).alias("r2")]


def average_ranks(rows: DataFrame, x: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, ties at their mean rank: counts of values, added up over ranges of their order."""
    counts = rows.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_total(counts, keys, [x], "_c", "_t").select(*keys, x, (F.col("_t") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name))
    return _beside(rows, ranks, [*keys, x])


def spearman(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    r = average_ranks(average_ranks(rows, x, "_rx", keys), y, "_ry", keys)
    return r.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"))


def queue_growth(rows: DataFrame, order: str, depth: str, keys: Sequence[str]) -> DataFrame:
    """Early and late means over ``min(n, max(5, n // 10))`` samples, slope, and whether growth is sustained."""
    w = W.partitionBy(*keys)
    d = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    d = d.withColumn("_w", F.least("_n", F.greatest(F.lit(5), F.floor(F.col("_n") / 10))))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.avg(F.when(F.col("_i") < F.col("_w"), F.col(depth))).alias("early_mean"), F.avg(F.when(F.col("_i") >= F.col("_n") - F.col("_w"), F.col(depth))).alias("late_mean"), F.coalesce(F.regr_slope(depth, "_i"), F.lit(0.0)).alias("slope"), F.max(depth).alias("max"))
    return g.withColumn("sustained_growth", (F.col("samples") >= 20) & (F.col("late_mean") > F.col("early_mean") + 0.5) & (F.col("slope") > 0.0005))


def crosstab(rows: DataFrame, group: str, code: str) -> DataFrame:
    """Counts of each (group, code) and their share of the group."""
    g = rows.groupBy(group, code).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def cohort_delta(rows: DataFrame, cohort: str, code: str, codes: Sequence[str], before: str, after: str) -> DataFrame:
    """Counts of each code of a fixed list in two cohorts, zero where absent, and their difference."""
    spark = rows.sparkSession
    full = spark.createDataFrame([(c,) for c in codes], f"{code} string")
    g = rows.groupBy(code).pivot(cohort, [before, after]).count()
    out = full.join(g, code, "left").fillna(0, [before, after])
    return out.withColumn("delta", F.col(after) - F.col(before))


def flag_counts(rows: DataFrame, group: str, flags: Sequence[str]) -> DataFrame:
    """(group, flag, n, fraction): how often each boolean flag holds."""
    long = rows.unpivot([group], list(flags), "flag", "value")
    return long.groupBy(group, "flag").agg(F.count_if("value").alias("n"), (F.count_if("value") / F.count(F.lit(1))).alias("fraction"))


def exploded_flags(rows: DataFrame, column: str, separator: str = ";") -> DataFrame:
    flags = rows.select(F.explode(F.split(column, separator)).alias("flag")).where("flag <> ''")
    return flags.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def supported_medians(rows: DataFrame, group: str, x: str, least: int = 10) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.median(x).alias("median")).where(F.col("n") >= least)


def histogram_map(key: str, n: str) -> Column:
    """A map from grouped (key, n) rows, in key order."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, n))))


def exact_mean(x: str, places: int = 2) -> Column:
    """The mean of numbers of so many decimal places, by a decimal sum, which does not depend on the order of the rows."""
    return F.sum(F.col(x).cast(f"decimal(18, {places})")).cast("double") / F.count(x)


#: How many digests go into one of the next level.
FAN_IN = 256


def fingerprint(rows: DataFrame, order: Sequence[str], fields: Sequence[str], block: str) -> DataFrame:
    """SHA-256 over the rows' fields: digests of blocks in order, then a digest of those.

    ``block`` is a column of order-preserving block names of bounded size.  Digests are combined FAN_IN at a time in
    the order of their blocks, level by level, so no row holds more, however many blocks there are.
    """
    line = F.concat_ws("|", *[F.col(f).cast("string") for f in fields])
    part = rows.groupBy(block).agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda s: s["_line"])), 256).alias("digest"))
    d = running_total(part.withColumn("_one", F.lit(1)), [], [block], "_one", "_n").select((F.col("_n") - 1).alias("_n"), "digest")
    left = d.count()
    while True:
        joined = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("_n", "digest"))), lambda s: s["digest"]))
        left = -(-left // FAN_IN)
        if left <= 1:
            return d.agg(F.sha2(joined, 256).alias("fingerprint"))
        d = d.groupBy(F.floor(F.col("_n") / FAN_IN).alias("_n")).agg(F.sha2(joined, 256).alias("digest"))


def quantile_or_zero(rows: DataFrame, x: str, p: float, keys: Sequence[str], name: str) -> DataFrame:
    """A quantile of each group that leaves out nulls and NaN; 0 for groups without any value."""
    return _beside_left(rows.select(*keys).distinct(), quantiles(rows, x, {name: p}, keys).drop("n"), keys).fillna(0.0, [name])


def flattened(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The plain columns, and the fields of the structs of ``names`` under their prefix; other structs and maps go."""
    plain = [f.name for f in rows.schema if f.dataType.typeName() not in ("struct", "map", "array")]
    return rows.select(*plain, *[F.col(f"{n}.{k}").alias(f"{n}_{k}") for n in names for k in rows.schema[n].dataType.names])
