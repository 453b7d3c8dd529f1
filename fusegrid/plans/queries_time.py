"""Queries over event streams: as-of joins, folds, blocks, gaps, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusegrid.operators import aggregates as A
from fusegrid.operators import joins, windows
from fusegrid.plans.registry import r6, registry
from fusegrid.sources import oracle as O
from fusegrid.sources import relations as R

QUERIES, ORACLES, query = registry()
#: Half an hour, the tolerance that these sparse events need.
TOLERANCE = 1_800_000_000
_SIDES = f"{O.events('click', 'lidar')}, {O.events('view', 'rgb')}"
_ASOF = f"WITH {_SIDES}, j AS (SELECT l.idx AS idx, l.ts AS ts, r.idx AS rgb_idx, r.ts AS rgb_ts FROM lidar l ASOF JOIN rgb r ON l.ts >= r.ts)"


def _sides(spark, sf):
    rgb = R.events(spark, sf, "view").select(F.col("idx").alias("rgb_idx"), F.col("ts").alias("rgb_ts"))
    return R.events(spark, sf, "click"), rgb


@query(f"{_ASOF} SELECT idx, rgb_idx, ts - rgb_ts AS age_us FROM j WHERE ts - rgb_ts <= {TOLERANCE}")
def asof_latest_past(spark, sf):
    j = joins.bucketed_asof(*_sides(spark, sf), "ts", "rgb_ts", TOLERANCE)
    return j.select("idx", "rgb_idx", (F.col("ts") - F.col("rgb_ts")).alias("age_us"))


@query(f"""{_ASOF} SELECT count(*) AS n, round(avg((ts - rgb_ts) / 1e3), 6) AS mean, round(median((ts - rgb_ts) / 1e3), 6) AS median, round(quantile_cont((ts - rgb_ts) / 1e3, 0.9), 6) AS p90,
round(quantile_cont((ts - rgb_ts) / 1e3, 0.95), 6) AS p95, round(quantile_cont((ts - rgb_ts) / 1e3, 0.99), 6) AS p99, round(max((ts - rgb_ts) / 1e3), 6) AS max FROM j WHERE ts - rgb_ts <= {TOLERANCE}""")  # fmt: skip
def sync_age_distribution(spark, sf):
    j = joins.bucketed_asof(*_sides(spark, sf), "ts", "rgb_ts", TOLERANCE).withColumn("age", (F.col("ts") - F.col("rgb_ts")) / 1e3)
    return A.timing_distribution(j, "age").select("n", *[r6(c) for c in ("mean", "median", "p90", "p95", "p99", "max")])


@query(f"""WITH {_SIDES}, c AS (SELECT l.idx AS idx, l.ts AS ts, r.idx AS rgb_idx, r.ts AS rgb_ts, row_number() OVER (PARTITION BY l.idx ORDER BY abs(l.ts - r.ts), r.ts) AS rn FROM lidar l JOIN rgb r ON r.ts BETWEEN l.ts - 86400000000 AND l.ts + 86400000000)
SELECT idx, rgb_idx, ts - rgb_ts AS offset_us FROM c WHERE rn = 1""")  # fmt: skip
def nearest_timestamp(spark, sf):
    """The closer neighbour within a day."""
    j = joins.nearest_timestamp(*_sides(spark, sf), "ts", "rgb_ts", 86_400_000_000)
    return j.select("idx", "rgb_idx", (F.col("ts") - F.col("rgb_ts")).alias("offset_us"))


_FOLD = f"""WITH RECURSIVE {O.MEASUREMENTS}, s AS (SELECT track, t, x, row_number() OVER (PARTITION BY track ORDER BY t, x) AS i, count(*) OVER (PARTITION BY track) AS n FROM measurements),
f AS (SELECT track, i, n, t, x, 0e0 AS v FROM s WHERE i = 1 UNION ALL SELECT s.track, s.i, s.n, s.t, s.x, CASE WHEN (CAST(s.t AS DOUBLE) - f.t) / 3.6e9 > 1e-6 THEN f.v * 0.72e0 + (s.x - f.x) / ((CAST(s.t AS DOUBLE) - f.t) / 3.6e9) * 0.28e0 ELSE f.v END FROM f JOIN s ON s.track = f.track AND s.i = f.i + 1)"""


@query(f"{_FOLD} SELECT track, n, round(v, 6) AS velocity FROM f WHERE i = n")
def ewma_velocity(spark, sf):
    return windows.ewma_velocity(R.measurements(spark, sf), "track", "t", "x", 3.6e9).select("track", "n", r6("velocity"))


@query(f"WITH {O.MEASUREMENTS}, d AS (SELECT track, t > lag(t) OVER (PARTITION BY track ORDER BY event_id) AS up FROM measurements) SELECT track, bool_and(coalesce(up, true)) AS strictly_increasing FROM d GROUP BY track")
def monotonic_audit(spark, sf):
    return windows.monotonic(R.measurements(spark, sf), ["track"], "event_id", "t")


@query(f"WITH {O.MEASUREMENTS} SELECT track, event_id, CAST(ntile(4) OVER (PARTITION BY track ORDER BY t) AS INTEGER) AS block FROM measurements")
def time_blocks_ntile(spark, sf):
    return windows.equal_blocks(R.measurements(spark, sf), ["track"], "t").select("track", "event_id", "block")


@query(f"""WITH {O.MEASUREMENTS}, r AS (SELECT track, event_id, row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM measurements)
SELECT track, event_id, CAST(least(i // CAST(ceil(n / 4e0) AS BIGINT) + 1, 4) AS INTEGER) AS block FROM r""")  # fmt: skip
def time_blocks_ceil(spark, sf):
    return windows.ceil_blocks(R.measurements(spark, sf), ["track"], "t").select("track", "event_id", "block")


@query(f"""WITH {O.MEASUREMENTS}, r AS (SELECT track, event_id, row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM measurements)
SELECT track, event_id FROM r WHERE n <= 5 OR i IN (SELECT CAST(round_even(j * (n - 1) / 4e0, 0) AS BIGINT) FROM (SELECT unnest(range(5)) AS j))""")  # fmt: skip
def even_sample(spark, sf):
    return windows.even_sample(R.measurements(spark, sf), ["track"], "t", 5).select("track", "event_id")


_DAYS = f"{O.MEASUREMENTS}, d AS (SELECT DISTINCT track, t // 86400000000 AS day FROM measurements)"


def _days(spark, sf):
    return R.measurements(spark, sf).select("track", F.floor(F.col("t") / 86_400_000_000).alias("day")).distinct()


@query(f"""WITH {_DAYS}, g AS (SELECT track, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY track)
SELECT g.track, g.day, d.day IS NOT NULL AS observed FROM g LEFT JOIN d ON g.track = d.track AND g.day = d.day""")  # fmt: skip
def gap_fill(spark, sf):
    return windows.gap_fill(_days(spark, sf), "track", "day").select("track", "day", "observed")


@query(f"""WITH {_DAYS}, p AS (SELECT track, day, CAST(track * day % 11 AS DOUBLE) / 10 AS x, 0e0 AS y FROM d),
n AS (SELECT *, CASE WHEN day = lag(day) OVER w + 1 AND abs(x - lag(x) OVER w) <= 0.88e0 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY track ORDER BY day)),
r AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY day) AS run FROM n) SELECT track, day, CAST(row_number() OVER (PARTITION BY track, run ORDER BY day) AS INTEGER) AS seed_count FROM r""")  # fmt: skip
def seed_runs(spark, sf):
    d = _days(spark, sf).withColumns({"x": F.pmod(F.col("track") * F.col("day"), F.lit(11)).cast("double") / 10, "y": F.lit(0.0)})
    return windows.run_counts(d, "track", "day", "x", "y").select("track", "day", "seed_count")


@query("""WITH r AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events)
SELECT previous, event_type AS state, count(*) AS n FROM r WHERE previous IS NOT NULL AND previous <> event_type GROUP BY previous, event_type""")  # fmt: skip
def identity_transitions(spark, sf):
    t = windows.transitions(R.table(spark, sf, "events"), "user_id", "ts", "event_type")
    return t.groupBy("previous", F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SIDES}, j AS (SELECT r.idx AS rgb_idx, l.idx AS idx, r.ts AS rgb_ts FROM rgb r ASOF JOIN lidar l ON r.ts >= l.ts)
SELECT rgb_idx, idx, CASE WHEN row_number() OVER (PARTITION BY idx ORDER BY rgb_ts) = 1 THEN 'LIDAR_MEASUREMENT' ELSE 'CAUSAL_PREDICTION' END AS state_source FROM j""")  # fmt: skip
def first_report_flag(spark, sf):
    lidar, rgb = _sides(spark, sf)
    scans = lidar.select("ts", F.col("idx").alias("scan"))
    j = joins.asof_latest(rgb.select(F.col("rgb_idx").alias("idx"), F.col("rgb_ts").alias("ts")), scans, carry=["scan"])
    j = j.select(F.col("idx").alias("rgb_idx"), F.col("ts").alias("rgb_ts"), F.col("scan").alias("idx"))
    return windows.first_report(j, "idx", "rgb_ts", "idx").select("rgb_idx", "idx", "state_source")


@query(f"""WITH {O.MEASUREMENTS}, q AS (SELECT track, t, event_id, CAST(event_id % 7 AS DOUBLE) AS depth, row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM measurements),
w AS (SELECT *, least(n, greatest(5, n // 10)) AS k FROM q)
SELECT track, count(*) AS samples, round(avg(depth) FILTER (i < k), 6) AS early_mean, round(avg(depth) FILTER (i >= n - k), 6) AS late_mean, round(coalesce(regr_slope(depth, i), 0e0), 6) AS slope,
  count(*) >= 20 AND avg(depth) FILTER (i >= n - k) > avg(depth) FILTER (i < k) + 0.5e0 AND coalesce(regr_slope(depth, i), 0e0) > 0.0005e0 AS sustained_growth FROM w GROUP BY track""")  # fmt: skip
def queue_growth(spark, sf):
    m = R.measurements(spark, sf).withColumn("depth", F.pmod("event_id", F.lit(7)).cast("double"))
    g = A.queue_growth(m, "t", "depth", ["track"])
    return g.select("track", "samples", r6("early_mean"), r6("late_mean"), r6("slope"), "sustained_growth")


@query(f"""WITH {O.MEASUREMENTS} SELECT track, count(*) AS n, round(corr(x, y), 6) AS r, round(regr_slope(x, y), 6) AS slope, round(regr_intercept(x, y), 6) AS intercept, round(regr_r2(x, y), 6) AS r2 FROM measurements GROUP BY track""")
def linear_trend(spark, sf):
    g = R.measurements(spark, sf).groupBy("track").agg(*A.linear_fit("x", "y"))
    return g.select("track", "n", *[r6(c) for c in ("r", "slope", "intercept", "r2")])


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2e0 AS rx,
rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2e0 AS ry FROM events) SELECT event_type, round(corr(rx, ry), 6) AS rho FROM r GROUP BY event_type""")  # fmt: skip
def spearman(spark, sf):
    s = A.spearman(R.table(spark, sf, "events"), "value", "user_id", ["event_type"])
    return s.select("event_type", r6("rho"))


@query("""WITH m AS (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS med FROM events)
SELECT event_type, count(*) AS n, round(any_value(med), 6) AS median, round(median(abs(value - med)), 6) AS mad,
  round(least(quantile_cont(value, 0.99), greatest(any_value(med) + 3 * 1.4826e0 * median(abs(value - med)), quantile_cont(value, 0.9))), 6) AS limit_ FROM m GROUP BY event_type HAVING count(*) >= 100""")  # fmt: skip
def mad_limit(spark, sf):
    g = A.robust_limit(R.table(spark, sf, "events"), "value", ["event_type"])
    return g.select("event_type", "n", r6("median"), r6("mad"), r6("limit", "limit_"))


@query("""WITH c AS (SELECT user_id, value, quantile_cont(value, 0.9) OVER (PARTITION BY user_id) AS cap FROM events)
SELECT user_id, round(CASE WHEN count(*) < 8 THEN 30e0 ELSE 2e0 * avg(least(value, cap)) END, 6) AS score FROM c GROUP BY user_id""")  # fmt: skip
def winsorized_mean(spark, sf):
    return A.winsorized_mean(R.table(spark, sf, "events"), "value", ["user_id"]).select("user_id", r6("score"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95,
round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events GROUP BY event_type""")  # fmt: skip
def module_timing_distribution(spark, sf):
    d = A.timing_distribution(R.table(spark, sf, "events"), "value", ["event_type"])
    return d.select("event_type", "n", *[r6(c) for c in ("mean", "median", "p90", "p95", "p99", "max")])


@query("""SELECT event_type, count(*) AS n, round((count(*) - 1) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9), 6) AS per_hour FROM events GROUP BY event_type""")
def rates(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = R.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), ((F.max(t) - F.min(t)) / 3.6e9).alias("hours"))
    return e.select("event_type", "n", r6((F.col("n") - 1) / F.col("hours"), "per_hour"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def json_props(spark, sf):
    e = R.table(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events) SELECT event_type, event_id, CAST(idx AS INTEGER) AS idx FROM r WHERE idx < 979""")
def indexed_events(spark, sf):
    """Numbered events of each topic, up to the topic's limit."""
    return windows.indexed(R.table(spark, sf, "events"), "event_type", ["ts", "event_id"], 979).select("event_type", "event_id", F.col("idx").cast("int").alias("idx"))


@query("""WITH t AS (SELECT user_id, epoch_us(ts) / 3.6e9 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, first_value(epoch_us(ts) / 3.6e9) OVER (PARTITION BY user_id ORDER BY ts) AS h0, event_id FROM events)
SELECT user_id, event_id, round(CASE WHEN h > h0 THEN (n - 1) / (h - h0) END, 6) AS rate FROM t""")  # fmt: skip
def running_rates(spark, sf):
    e = R.table(spark, sf, "events").withColumn("h", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    return windows.running_rate(e, ["user_id"], "h", 1.0).select("user_id", "event_id", r6("rate"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 3.6e9 AS due, value / 4e0 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
f AS (SELECT user_id, i, due, true AS processed, due + cost AS free FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.due, f.free - e.due <= 6e0, CASE WHEN f.free - e.due <= 6e0 THEN greatest(f.free, e.due) + e.cost ELSE f.free END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, count(*) AS n, count(*) FILTER (processed) AS processed FROM f GROUP BY user_id""")  # fmt: skip
def backlog_drops(spark, sf):
    """How many frames one worker processes when it drops those more than six hours late."""
    e = R.table(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("due"), (F.col("value") / 4).alias("cost"))
    d = windows.backlog_drops(e, ["user_id"], "due", "cost", 6.0)
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("processed").alias("processed"))
