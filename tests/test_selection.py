"""Quantiles by selection and digests by levels, against plain arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusegrid.operators import aggregates as A
from fusegrid.operators.selection import quantiles

AT = {"least": 0.0, "p05": 0.05, "median": 0.5, "p99": 0.99, "most": 1.0}


def expected(rows):
    groups = {}
    for k, x in rows:
        if x is not None and not math.isnan(x):
            groups.setdefault(k, []).append(x)
    return {k: (len(v), *[pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=1e-300) for p in AT.values()]) for k, v in groups.items()}


def test_quantiles_equal_sorted_values(spark):
    rng = random.Random(2)
    rows = [("even", rng.random()) for _ in range(5000)] + [("few", float(rng.randrange(4))) for _ in range(700)] + [("one", 3.5)] * 3 + [(None, -1.0), (None, 2.0), ("none", None), ("nan", float("nan"))]
    rows += [("wide", s * 10.0**e) for e in range(-300, 301, 10) for s in (-1, 1)] + [("wide", 0.0)] * 5 + [("close", 1.0 + i * 2.0**-52) for i in range(50)] + [("tail", 1.0)] * 400 + [("tail", 1e300)]
    d = spark.createDataFrame(rows, "k string, x double").repartition(9)
    got = {r.k: tuple(r)[1:] for r in quantiles(d, "x", AT, ["k"]).collect()}
    want = expected(rows)
    assert got.keys() == want.keys() == {"even", "few", "one", None, "wide", "close", "tail"}
    for k, v in want.items():
        assert got[k] == v, k


def test_quantiles_of_infinite_values_and_of_whole_tables(spark):
    inf = math.inf
    d = spark.createDataFrame([(v,) for v in (-inf, -inf, 1.0, 2.0, 3.0, inf)], "x double")
    r = quantiles(d, "x", {"a": 0.2, "b": 0.4, "c": 0.8, "d": 1.0}, more={"total": F.count("_x")}).first()
    assert (r.n, r.a, r.b, r.c, r.d, r.total) == (6, -inf, 1.0, 3.0, inf, 6)
    assert quantiles(d.where("x > 5 and x < 6"), "x", AT).collect() == []


def test_quantile_or_zero_keeps_groups_without_a_value(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "k string, x double")
    assert {r.k: r.m for r in A.quantile_or_zero(d, "x", 0.5, ["k"], "m").collect()} == {"a": 2.0, "b": 0.0, None: 5.0}


def test_no_plan_gathers_the_values_of_a_group(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("x"))
    for out in (A.timing_distribution(d, "x", ["k"]), A.error_distribution(d, "x"), A.robust_limit(d, "x", ["k"]), A.winsorized_mean(d, "x", ["k"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan and "median(" not in plan and out.count()


def test_fingerprint_by_levels_does_not_depend_on_partitions(spark):
    blocks = 256 * 2 + 5
    d = spark.range(blocks * 3).select("id", F.floor(F.col("id") / 3).alias("block"))
    digest = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    level = [digest([str(i) for i in range(3 * b, 3 * b + 3)]) for b in range(blocks)]
    while len(level) > 1:
        level = [digest(level[i : i + A.FAN_IN]) for i in range(0, len(level), A.FAN_IN)]
    for n in (1, 200):
        assert A.fingerprint(d.repartition(n), ["id"], ["id"], "block").first()[0] == level[0]
