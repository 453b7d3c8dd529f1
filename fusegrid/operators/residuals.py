"""Residual audit: does a steady column offset of the projection explain the residuals of a scene's first scans?

A scene is in WARMUP until it has ``warmup`` scans; then an estimate is made once, from those scans alone, and reported
as PASS or FAIL.  It is never applied.  The offset is the median residual of the fitting scans, on the search grid; it
must be stable over blocks of scans, agree over depths and image regions, and explain the scans held out.  All that is
grouped is of a bounded number of scans, however long the scene.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.operators.aggregates import quantile
from fusegrid.operators.windows import equal_blocks

#: fixed values: the audit's limits (scans, shares, pixels, metres)
CONFIG = {"fit_fraction": 0.7, "search": (-80.0, 120.0, 2.0), "dynamic_frames": 18, "bin_samples": 8, "block_spread": 12.0, "depth_spread": 12.0, "region_spread": 12.0, "improvement": 0.05, "depths": (4.0, 8.0), "columns": (1280 / 3, 2560 / 3)}
CHECKS = ("enough_frames", "block_stable", "depth_consistent", "region_consistent", "holdout_improved")


def _spread(rows: DataFrame, name: str) -> DataFrame:
    """(scene, number of groups, spread of their medians) of rows (scene, median)."""
    return rows.groupBy("scene").agg(F.count(F.lit(1)).alias(f"{name}_groups"), (F.max("median") - F.min("median")).alias(f"{name}_spread"))


def residual_audit(samples: DataFrame, scans: DataFrame, warmup: int = 60, config: Mapping = CONFIG) -> DataFrame:
    """A row for each scene of ``scans`` (scene, frame): state, offset, candidate, spreads, hold-out errors and checks.

    samples: scene, frame, residual, depth, u.  Samples that are null or not finite are left out, so a bad
    estimate is a FAIL and no error; scenes still in WARMUP have nulls.
    """
    c = config
    low, high, step = c["search"]
    order = scans.select("scene", "frame").distinct().withColumn("i", F.row_number().over(W.partitionBy("scene").orderBy("frame")) - 1)
    scenes = order.groupBy("scene").agg(F.count(F.lit(1)).alias("scans"))
    good = reduce(and_, [F.abs(x) < float("inf") for x in ("residual", "depth", "u")])
    s = samples.where(good).join(order.where(F.col("i") < warmup), ["scene", "frame"]).join(scenes.where(F.col("scans") >= warmup), "scene")
    s = s.withColumn("fit", F.col("i") < int(c["fit_fraction"] * warmup))
    fit = s.where("fit")
    medians = fit.groupBy("scene", "frame", "i").agg(quantile("residual", 0.5).alias("median"))
    blocks = equal_blocks(medians, ["scene"], "i").groupBy("scene", "block").agg(quantile("median", 0.5).alias("median"))

    def binned(x: str, at: tuple[float, float]) -> DataFrame:
        b = F.when(F.col(x) < at[0], 0).when(F.col(x) < at[1], 1).otherwise(2)
        g = fit.groupBy("scene", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), quantile("residual", 0.5).alias("median"))
        return g.where(F.col("n") >= c["bin_samples"])

    offset = s.groupBy("scene").agg(F.countDistinct("frame").alias("dynamic_frames"), F.coalesce(quantile(F.when(F.col("fit"), F.col("residual")), 0.5), F.lit(0.0)).alias("dynamic_du"))
    offset = offset.withColumn("candidate", F.least(F.greatest(F.rint(F.col("dynamic_du") / step) * step, F.lit(low)), F.lit(high)))
    held = s.where("not fit").join(offset.select("scene", "candidate"), "scene")
    errors = held.groupBy("scene").agg(quantile(F.abs("residual"), 0.5).alias("hold_baseline"), quantile(F.abs(F.col("residual") - F.col("candidate")), 0.5).alias("hold_candidate"))
    out = scenes
    for part in (offset, errors, _spread(blocks, "block"), _spread(binned("depth", c["depths"]), "depth"), _spread(binned("u", c["columns"]), "region")):
        out = out.join(part, "scene", "left")
    out = out.withColumn("improvement", F.coalesce(1 - F.col("hold_candidate") / F.greatest("hold_baseline", F.lit(1e-6)), F.lit(0.0)))
    steady = lambda name, groups: (F.col(f"{name}_groups") >= groups) & (F.col(f"{name}_spread") <= c[f"{name}_spread"])
    checks = dict(zip(CHECKS, (F.col("dynamic_frames") >= c["dynamic_frames"], steady("block", 1), steady("depth", 2), steady("region", 2), F.col("improvement") >= c["improvement"]), strict=True))
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    passed = reduce(and_, map(F.col, CHECKS))
    done = F.col("scans") >= warmup
    out = out.withColumn("state", F.when(~done, "WARMUP").when(passed, "PASS").otherwise("FAIL"))
    numbers = ("dynamic_du", "candidate", "block_spread", "depth_spread", "region_spread", "hold_baseline", "hold_candidate", "improvement")
    return out.select("scene", "state", "scans", F.when(done, F.coalesce("dynamic_frames", F.lit(0))).alias("dynamic_frames"), *[F.when(done, F.col(x)).alias(x) for x in numbers], *[F.when(done, F.col(k)).alias(k) for k in CHECKS])
