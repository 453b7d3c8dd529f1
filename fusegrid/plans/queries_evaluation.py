"""Queries that score, compare and audit: assignment, metrics, taxonomies, searches, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusegrid.functions import boxes as B
from fusegrid.functions import vectors as V
from fusegrid.operators import aggregates as A
from fusegrid.operators import assign, audit, joins
from fusegrid.plans.registry import r6, registry
from fusegrid.sources import oracle as O
from fusegrid.sources import relations as R

QUERIES, ORACLES, query = registry()


def _pairs(spark, sf):
    p = R.predicted(spark, sf)
    g = R.truth(spark, sf).select("frame", "gt", *[F.col(c).alias(f"g{c}") for c in "xyz"])
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"g{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return p.join(g, "frame").withColumn("d", d)


# The six ways to match three places with three.  A frame of n predictions and m targets has max(n, m) places on either side;
# a match with a place that holds none is free, and places beyond are matched with one another.
_MATCHED = f"""WITH {O.placed('pred', 'pred', 8)}, {O.placed('gt', 'gt', 11, 0.05)},
p AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY pred) - 1 AS i FROM pred), t AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY gt) - 1 AS j FROM gt),
sizes AS (SELECT frame, n, m, greatest(n, m) AS s FROM (SELECT frame, count(*) AS n FROM p GROUP BY frame) JOIN (SELECT frame, count(*) AS m FROM t GROUP BY frame) USING (frame)),
cell AS (SELECT z.frame, a.i, b.j, CASE WHEN a.i < n AND b.j < m THEN sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2) + power(p.z - t.z, 2)) WHEN (a.i < s) = (b.j < s) THEN 0e0 ELSE 1e9 END AS c, p.pred, t.gt
  FROM sizes z CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) a CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) b LEFT JOIN p ON p.frame = z.frame AND p.i = a.i LEFT JOIN t ON t.frame = z.frame AND t.j = b.j),
ways AS (SELECT a.frame, a.j AS j0, b.j AS j1, c.j AS j2, a.c + b.c + c.c AS total FROM cell a JOIN cell b ON a.frame = b.frame AND b.i = 1 JOIN cell c ON a.frame = c.frame AND c.i = 2 WHERE a.i = 0 AND a.j <> b.j AND a.j <> c.j AND b.j <> c.j),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY total, j0, j1) AS rn FROM ways) WHERE rn = 1),
hits AS (SELECT cell.frame, pred, gt, c AS d FROM best JOIN cell ON cell.frame = best.frame AND cell.j = CASE cell.i WHEN 0 THEN j0 WHEN 1 THEN j1 ELSE j2 END WHERE pred IS NOT NULL AND gt IS NOT NULL AND c <= 1.5e0)"""


def _hits(spark, sf):
    return assign.assign(_pairs(spark, sf), ["frame"], "pred", "gt", "d", None, 1.5)


@query(f"{_MATCHED} SELECT frame, pred, gt, round(d, 6) AS d FROM hits")
def assignment_gt(spark, sf):
    """Optimal matches of predictions and targets, gated at 1.5 m after the optimum."""
    return _hits(spark, sf).select("frame", "pred", "gt", r6("d"))


@query(f"""{_MATCHED}, c AS (SELECT (SELECT count(*) FROM hits) AS tp, (SELECT count(*) FROM pred) - (SELECT count(*) FROM hits) AS fp, (SELECT count(*) FROM gt) - (SELECT count(*) FROM hits) AS fn),
m AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")  # fmt: skip
def precision_recall_f1(spark, sf):
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    c = one(_hits(spark, sf), "tp").crossJoin(one(R.predicted(spark, sf), "p")).crossJoin(one(R.truth(spark, sf), "g"))
    return A.detection_metrics(c.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))).select("tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query(f"{_MATCHED} SELECT count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(median(d), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max FROM hits")
def error_distribution(spark, sf):
    return A.error_distribution(_hits(spark, sf), "d").select("n", *[r6(c) for c in ("rmse", "p50", "p95", "max")])


@query(f"""{_MATCHED}, ranged AS (SELECT g.frame, g.gt, sqrt(g.x * g.x + g.y * g.y) AS r, h.pred IS NOT NULL AS hit FROM gt g LEFT JOIN hits h ON g.frame = h.frame AND g.gt = h.gt)
SELECT CASE WHEN r < 3 THEN '0-3m' WHEN r < 6 THEN '3-6m' WHEN r < 9 THEN '6-9m' ELSE '>9m' END AS xy_range_bin, count(*) AS n, count(*) FILTER (hit) AS tp, round(count(*) FILTER (hit) / greatest(count(*), 1), 6) AS recall FROM ranged GROUP BY 1""")  # fmt: skip
def recall_by_range(spark, sf):
    t = R.truth(spark, sf).join(_hits(spark, sf).select("frame", "gt", F.lit(True).alias("hit")), ["frame", "gt"], "left").fillna(False, ["hit"])
    t = t.groupBy(B.depth_bin(F.hypot("x", "y")).alias("xy_range_bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("tp"))
    return t.withColumn("recall", F.round(A.ratio(F.col("tp"), F.col("n")), 6))


@query(f"{_MATCHED} SELECT frame, gt FROM gt EXCEPT SELECT frame, gt FROM hits")
def fn_antijoin(spark, sf):
    return R.truth(spark, sf).join(_hits(spark, sf), ["frame", "gt"], "left_anti").select("frame", "gt")


@query(f"{_MATCHED} SELECT frame, pred FROM pred EXCEPT SELECT frame, pred FROM hits")
def fp_antijoin(spark, sf):
    return R.predicted(spark, sf).join(_hits(spark, sf), ["frame", "pred"], "left_anti").select("frame", "pred")


@query(f"""{_MATCHED}, o AS (SELECT a.frame, a.gt, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS nearest FROM gt a JOIN gt b ON a.frame = b.frame AND a.gt <> b.gt GROUP BY a.frame, a.gt)
SELECT g.frame, g.gt, round(o.nearest, 6) AS nearest FROM gt g LEFT JOIN o ON g.frame = o.frame AND g.gt = o.gt""")  # fmt: skip
def nearest_other(spark, sf):
    return joins.nearest_other(R.truth(spark, sf), ["frame"], "gt").select("frame", "gt", r6("nearest"))


_AB = f"""WITH {O.POINTS}, {O.BOXES}, la AS (SELECT * FROM boxes), lb AS (SELECT frame, det, x1 + 8 AS x1, y1 + 6 AS y1, x2 + 8 AS x2, y2 + 6 AS y2 FROM boxes)"""


@query(f"""{_AB}, i AS (SELECT a.frame, a.det, b.det AS b_det, greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS both_, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM la a JOIN lb b ON a.frame = b.frame),
c AS (SELECT *, 1e0 - both_ / greatest(sa + sb - both_, 1e-9) AS cost FROM i), w AS (SELECT p.frame, p.cost + q.cost + r.cost + s.cost AS total FROM c p JOIN c q ON p.frame = q.frame AND q.det = 1 JOIN c r ON p.frame = r.frame AND r.det = 2 JOIN c s ON p.frame = s.frame AND s.det = 3
  WHERE p.det = 0 AND p.b_det <> q.b_det AND p.b_det <> r.b_det AND q.b_det <> r.b_det AND s.b_det <> p.b_det AND s.b_det <> q.b_det AND s.b_det <> r.b_det)
SELECT frame, round(min(total), 6) AS total FROM w GROUP BY frame""")  # fmt: skip
def assignment_boxes_ab(spark, sf):
    """Total cost of the optimum of two box logs of each frame; the matching itself may tie."""
    b = R.boxes(R.points(spark, sf))
    other = b.select("frame", F.col("det").alias("b_det"), *[(F.col(c) + s).alias(f"b_{c}") for c, s in (("x1", 8), ("y1", 6), ("x2", 8), ("y2", 6))])
    c = b.join(other, "frame").withColumn("cost", F.lit(1.0) - B.iou(B.box(""), B.box("b_")))
    return assign.assign(c, ["frame"], "det", "b_det", "cost", None, 2.0).groupBy("frame").agg(F.round(F.sum("cost"), 6).alias("total"))


@query(f"""{_AB}, g AS (SELECT a.frame, a.det, b.det AS r_det, greatest(abs(a.x1 - b.x1), abs(a.y1 - b.y1), abs(a.x2 - b.x2), abs(a.y2 - b.y2)) AS gap FROM la a JOIN lb b ON a.frame = b.frame),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, det ORDER BY gap, r_det) AS rn FROM g) SELECT frame, det, r_det, round(gap, 6) AS gap, gap <= 8e0 AS same FROM r WHERE rn = 1""")  # fmt: skip
def nearest_box_match(spark, sf):
    b = R.boxes(R.points(spark, sf))
    left = b.select("frame", "det", *[F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2")])
    right = b.select("frame", F.col("det").alias("r_det"), *[(F.col(c) + s).alias(f"r_{c}") for c, s in (("x1", 8), ("y1", 6), ("x2", 8), ("y2", 6))])
    return joins.nearest_box(left, right, ["frame"], "det", 8.0).select("frame", "det", "r_det", r6("gap"), "same")


@query(f"""WITH {O.LOGS} SELECT count(*) FILTER (la.frame IS NOT NULL AND lb.frame IS NOT NULL) AS joined, count(*) FILTER (lb.frame IS NULL) AS left_only, count(*) FILTER (la.frame IS NULL) AS right_only,
count(*) FILTER (la.frame IS NOT NULL AND lb.frame IS NOT NULL AND la.x IS DISTINCT FROM lb.x) AS x_mismatches, count(*) FILTER (la.frame IS NOT NULL AND lb.frame IS NOT NULL AND la.state IS DISTINCT FROM lb.state) AS state_mismatches
FROM la FULL OUTER JOIN lb ON la.frame = lb.frame""")  # fmt: skip
def log_equality_audit(spark, sf):
    return joins.null_safe_mismatches(R.log(spark, sf, "a"), R.log(spark, sf, "b"), ["frame"], ["x", "state"])


@query(f"""WITH {O.LOGS} SELECT 'a_only' AS side, count(*) AS n FROM (SELECT frame FROM la EXCEPT SELECT frame FROM lb) UNION ALL SELECT 'b_only', count(*) FROM (SELECT frame FROM lb EXCEPT SELECT frame FROM la)
UNION ALL SELECT 'both', count(*) FROM (SELECT frame FROM la INTERSECT SELECT frame FROM lb) UNION ALL SELECT 'either', count(*) FROM (SELECT frame FROM la UNION SELECT frame FROM lb)""")  # fmt: skip
def set_ops_frames(spark, sf):
    a, b = (R.log(spark, sf, k).select("frame") for k in "ab")
    parts = [("a_only", a.exceptAll(b)), ("b_only", b.exceptAll(a)), ("both", a.intersect(b)), ("either", a.union(b).distinct())]
    rows = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "n") for k, d in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(f"WITH {O.LOGS} SELECT la.frame, la.track_id FROM la JOIN lb ON la.frame = lb.frame WHERE lb.state IS NULL AND la.state IS NOT NULL")
def resolved_cases(spark, sf):
    """Rows with a state in one log and none in the other."""
    a, b = R.log(spark, sf, "a").where("state is not null"), R.log(spark, sf, "b").where("state is null").select("frame")
    return a.join(b, "frame", "left_semi").select("frame", "track_id")


@query(f"WITH {O.LOGS}, u AS (SELECT frame, track_id, x, CAST(NULL AS VARCHAR) AS state FROM la UNION ALL BY NAME SELECT frame, state FROM lb) SELECT count(*) AS n, count(x) AS n_x, count(state) AS n_state FROM u")
def union_schema(spark, sf):
    a, b = R.log(spark, sf, "a").select("frame", "track_id", "x"), R.log(spark, sf, "b").select("frame", "state")
    return joins.union_schemas(a, b).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_x"), F.count("state").alias("n_state"))


@query(f"""WITH {O.LOGS}, b AS (SELECT frame // 256 AS block, sha256(string_agg(frame || '|' || track_id || '|' || coalesce(state, ''), chr(10) ORDER BY frame)) AS digest FROM la GROUP BY 1),
c AS (SELECT n // {A.FAN_IN} AS node, sha256(string_agg(digest, chr(10) ORDER BY n)) AS digest FROM (SELECT digest, row_number() OVER (ORDER BY block) - 1 AS n FROM b) GROUP BY 1)
SELECT CASE WHEN count(*) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, chr(10) ORDER BY node)) END AS fingerprint FROM c""")  # fmt: skip
def fingerprint(spark, sf):
    a = R.log(spark, sf, "a").withColumn("block", F.floor(F.col("frame") / 256)).fillna("", ["state"])
    return A.fingerprint(a, ["frame"], ["frame", "track_id", "state"], "block")


@query("""SELECT l_returnflag AS subtype, l_linestatus AS code, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS fraction FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def crosstab_fraction(spark, sf):
    c = A.crosstab(R.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("subtype"), F.col("l_linestatus").alias("code")), "subtype", "code")
    return c.select("subtype", "code", "n", r6("fraction"))


@query("""SELECT c.code, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority IS NOT NULL) AS "F", count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority IS NOT NULL) AS "O", count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority IS NOT NULL) - count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority IS NOT NULL) AS delta
FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) AS code) c LEFT JOIN orders ON o_orderpriority = c.code GROUP BY c.code""")  # fmt: skip
def cohort_pivot_delta(spark, sf):
    o = R.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("code"), "o_orderstatus")
    return A.cohort_delta(o, "o_orderstatus", "code", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"], "F", "O")


@query("""WITH f AS (SELECT l_returnflag AS subtype, unnest([{'flag': 'bulk', 'value': l_quantity > 30}, {'flag': 'cheap', 'value': l_extendedprice < 20000}, {'flag': 'cut', 'value': l_discount > 0.05e0}]) AS s FROM lineitem)
SELECT subtype, s.flag AS flag, count(*) FILTER (s.value) AS n, round(count(*) FILTER (s.value) / count(*), 6) AS fraction FROM f GROUP BY subtype, s.flag""")  # fmt: skip
def flag_unpivot(spark, sf):
    t = R.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("subtype"), (F.col("l_quantity") > 30).alias("bulk"), (F.col("l_extendedprice") < 20000).alias("cheap"), (F.col("l_discount") > 0.05).alias("cut"))
    return A.flag_counts(t, "subtype", ["bulk", "cheap", "cut"]).select("subtype", "flag", "n", r6("fraction"))


@query("""WITH f AS (SELECT unnest(string_split(concat_ws(';', CASE WHEN l_quantity > 30 THEN 'bulk' END, CASE WHEN l_extendedprice < 20000 THEN 'cheap' END, CASE WHEN l_discount > 0.05e0 THEN 'cut' END), ';')) AS flag FROM lineitem)
SELECT flag, count(*) AS n FROM f WHERE flag <> '' GROUP BY flag""")  # fmt: skip
def flag_explode(spark, sf):
    t = R.table(spark, sf, "lineitem")
    flags = audit.joined_flags({"bulk": F.col("l_quantity") > 30, "cheap": F.col("l_extendedprice") < 20000, "cut": F.col("l_discount") > 0.05})
    return A.exploded_flags(t.select(flags.alias("flags")), "flags")


@query("SELECT l_suppkey AS k, count(*) AS n, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 10")
def group_medians_min_support(spark, sf):
    return A.supported_medians(R.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "k"), "k", "l_extendedprice").select("k", "n", r6("median"))


_GRID = f"""WITH {O.BASE}, g AS (SELECT unnest(range(-80, 121, 20)) AS du), s AS (SELECT du, CASE WHEN frame % 10 < 7 THEN 'fit' ELSE 'hold' END AS part, abs((x1 + x2) / 2 - u - du) AS e FROM owned CROSS JOIN g),
m AS (SELECT part, du, avg(e) AS score FROM s GROUP BY part, du)"""


def _grid(spark, sf):
    p = R.projected(R.points(spark, sf))
    from fusegrid.functions import geometry as G
    from fusegrid.functions import model as M

    own = joins.owners(p.where(F.col("valid") & G.in_view("u", "v", "depth") & G.within("h", M.BROAD_HEIGHT)), R.boxes(R.points(spark, sf)))
    grid = spark.range(11).select((F.col("id") * 20 - 80).alias("du"))
    s = own.select(F.when(F.col("frame") % 10 < 7, "fit").otherwise("hold").alias("part"), ((F.col("x1") + F.col("x2")) / 2 - F.col("u")).alias("r")).crossJoin(F.broadcast(grid))
    return s.groupBy("part", "du").agg(F.avg(F.abs(F.col("r") - F.col("du"))).alias("score"))


@query(f"{_GRID} SELECT part, min_by(du, round(score, 9)) AS du, round(min(score), 6) AS score FROM m GROUP BY part")
def grid_search_best(spark, sf):
    """The shift of least mean offset on each part."""
    return _grid(spark, sf).groupBy("part").agg(F.min_by("du", F.round("score", 9)).alias("du"), F.round(F.min("score"), 6).alias("score"))


@query(f"""{_GRID}, f AS (SELECT min_by(du, round(score, 9)) AS du FROM m WHERE part = 'fit') SELECT f.du, round(a.score, 6) AS frozen, round(b.score, 6) AS unshifted, a.score < b.score AS improves
FROM f JOIN m a ON a.part = 'hold' AND a.du = f.du JOIN m b ON b.part = 'hold' AND b.du = 0""")  # fmt: skip
def train_freeze_validate(spark, sf):
    """The shift frozen on the fit part, judged on the rest."""
    m = _grid(spark, sf)
    frozen = m.where("part = 'fit'").agg(F.min_by("du", F.round("score", 9)).alias("du"))
    hold = m.where("part = 'hold'")
    a = hold.join(F.broadcast(frozen), "du").select("du", F.col("score").alias("a"))
    return a.crossJoin(F.broadcast(hold.where("du = 0").select(F.col("score").alias("b")))).select("du", r6("a", "frozen"), r6("b", "unshifted"), (F.col("a") < F.col("b")).alias("improves"))


@query("""SELECT n_regionkey, max_by(s.s_nationkey, struct_pack(a := s.ok, b := s.n, c := -s.bal, d := -s.s_nationkey)) AS best FROM (SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 6) AS bal, avg(s_acctbal) > 3000 AS ok FROM supplier GROUP BY s_nationkey) s
JOIN nation ON s.s_nationkey = n_nationkey GROUP BY n_regionkey""")  # fmt: skip
def lexicographic_best(spark, sf):
    s = R.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal"), 6).alias("bal"), (F.avg("s_acctbal") > 3000).alias("ok"))
    s = s.join(R.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return audit.best_configuration(s, ["n_regionkey"], "s_nationkey", [F.col("ok"), F.col("n"), -F.col("bal"), -F.col("s_nationkey")]).withColumnRenamed("s_nationkey", "best")


_RUN = {
    "output_hz": "count(*) / CAST(2 AS DOUBLE)", "processed_fraction": "1 - count(CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 1 END) / CAST(count(*) AS DOUBLE)", "lidar_hz": "9 + count(*) / CAST(50 AS DOUBLE)", "wall_ratio": "CAST(0.9 AS DOUBLE) + user_id % 5 / CAST(20 AS DOUBLE)",
    "queue_growth": "user_id % 11 = 0", "render_depth": "max(event_id % 2)", "video_depth": "max(event_id % 13) + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END", "recording": "user_id % 3 = 0", "video_dropped": "user_id % 4", "video_written": "count(*) - user_id % 2", "processed": "count(*)",
    "future_reads": "count(CASE WHEN value < 0 THEN 1 END)", "repeated_timestamps": "count(*) - count(DISTINCT ts)", "unknown_sources": "count(CASE WHEN event_type NOT IN ('click', 'view', 'error', 'purchase', 'signup') AND event_id % 97 = 0 THEN 1 END)",
    "duplicate_identities": "count(CASE WHEN event_id % 997 = 0 THEN 1 END)", "robot_z_rows": "user_id % 13 % 2", "rgb_count": "count(*)", "rgb_expected": "count(event_id)", "lidar_count": "count(value)", "lidar_expected": "count(*)",
    "robot_rows": "user_id % 6 % 2", "reid": "user_id % 23 = 0", "persistent": "user_id % 19 = 0", "other_ids": "count(CASE WHEN event_id % 1009 = 0 THEN 1 END)",
}
_CHECKS = {
    "rgb_output_rate_pass": "output_hz >= 29", "rgb_processed_fraction_pass": "processed_fraction >= 0.99e0", "lidar_update_rate_pass": "lidar_hz BETWEEN 9.5e0 AND 10.5e0", "lidar_p95_pass": "lidar_p95_ms < 100", "bounded_queue_pass": "NOT queue_growth AND render_depth <= 1 AND video_depth <= 12",
    "recording_complete_pass": "NOT recording OR (video_dropped = 0 AND video_written = processed)", "no_future_sensor_access_pass": "future_reads = 0", "timestamp_monotonic_unique_pass": "repeated_timestamps = 0", "state_source_pass": "unknown_sources = 0", "no_duplicate_fixed_g_pass": "duplicate_identities = 0",
    "robot_z_unavailable_pass": "robot_z_rows = 0", "declared_scope_count_pass": "rgb_count = rgb_expected AND lidar_count = lidar_expected", "runtime_mode_pass": "wall_ratio BETWEEN 0.95e0 AND 1.1e0",
    "robot_inference_zero_pass": "robot_rows = 0", "reid_disabled_pass": "NOT reid", "persistent_identity_disabled_pass": "NOT persistent", "temporary_t_ids_only_pass": "other_ids = 0",
}
_METRICS = ", ".join(f"{v} AS {k}" for k, v in _RUN.items())
_HOLD = {k: f"coalesce({v}, false)" for k, v in _CHECKS.items()}


@query(f"""WITH m AS (SELECT user_id, {_METRICS}, quantile_cont(value, 0.95) AS lidar_p95_ms FROM events GROUP BY user_id), g AS (SELECT user_id, {", ".join(f"{v} AS {k}" for k, v in _HOLD.items())} FROM m)
SELECT *, {" AND ".join(_CHECKS)} AS passed, 'PERSON_ONLY_LIGHTWEIGHT_30HZ_' || CASE WHEN {" AND ".join(_CHECKS)} AND user_id % 29 <> 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")  # fmt: skip
def runtime_gate(spark, sf):
    """All seventeen checks of each run and its status; a user's events stand for a run's log."""
    e = R.table(spark, sf, "events")
    m = e.groupBy("user_id").agg(*[F.expr(v).alias(k) for k, v in _RUN.items()], A.quantile("value", 0.95).alias("lidar_p95_ms"))
    checks = audit.runtime_checks(realtime=True, lightweight=True)
    g = audit.gate(m, checks)
    return g.select("user_id", *checks, "passed", audit.run_status(F.col("passed"), F.col("user_id") % 29 == 0, lightweight=True).alias("status"))


@query("""SELECT CASE WHEN NOT (l_partkey % 11 <> 0) THEN 'NO_OCCUPANCY_DELETED_COMPONENT' WHEN l_quantity < 3 THEN 'TOO_FEW_POINTS' WHEN NOT (l_suppkey % 5 <> 0) THEN 'CENTER_OUTSIDE_ORIGINAL_BOX' WHEN NOT (l_linenumber <> 2) THEN 'IMPLAUSIBLE_3D_SIZE'
WHEN l_discount * 15e0 > 1.15e0 THEN 'COMPONENT_SCORE_ABOVE_EXISTING_ASSIGNMENT_LIMIT' WHEN l_returnflag = 'R' THEN 'NEIGHBOR_PERSON_COMPETITION' WHEN l_linestatus = 'F' THEN 'AMBIGUOUS_COMPONENT_RANKING' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""")  # fmt: skip
def quality_ladder(spark, sf):
    q = audit.candidate_quality(F.expr("l_partkey % 11 <> 0"), "l_quantity", F.expr("l_suppkey % 5 <> 0"), F.expr("l_linenumber <> 2"), F.expr("l_discount * 15d"), F.expr("l_returnflag = 'R'"), F.expr("l_linestatus = 'F'"))
    return R.table(spark, sf, "lineitem").groupBy(q.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {O.POINTS}, f AS (SELECT DISTINCT frame FROM points), n AS (SELECT max(frame) + 1 AS n FROM f)
SELECT CASE WHEN frame / n < 0.5e0 THEN 'TRAIN_FIT' WHEN frame / n < 0.6e0 THEN 'TRAIN_CALIBRATION' WHEN frame / n < 0.8e0 THEN 'VALIDATION' WHEN frame / n < 0.85e0 THEN 'EMBARGO' ELSE 'TEST' END AS split, count(*) AS n_frames FROM f CROSS JOIN n GROUP BY 1""")  # fmt: skip
def split_manifest(spark, sf):
    f = R.points(spark, sf).select("frame").distinct()
    n = f.agg((F.max("frame") + 1).alias("n"))
    return f.crossJoin(F.broadcast(n)).groupBy(audit.split_of(F.col("frame"), F.col("n")).alias("split")).agg(F.count(F.lit(1)).alias("n_frames"))


@query(f"WITH {O.POINTS} SELECT count(DISTINCT frame) AS n, max(frame) AS last, count(DISTINCT frame) = max(frame) + 1 AND min(frame) = 0 AS contiguous FROM points")
def manifest_contiguity(spark, sf):
    return audit.contiguous(R.points(spark, sf).select("frame").distinct(), "frame")


_EMB = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT label, i, avg(v[i]) AS c FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY label, i),
q AS (SELECT label, list(c ORDER BY i) AS c FROM p GROUP BY label), proto AS (SELECT label, list_transform(c, lambda x: x / greatest(sqrt(list_inner_product(c, c)), 1e-8)) AS c FROM q)"""


def _protos(spark, sf):
    e = R.table(spark, sf, "embeddings").select("label", F.posexplode(V.as_double("embedding")).alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.avg("x").alias("c")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    return c.select("label", V.normalized("c").alias("c"))


@query(f"{_EMB}, d AS (SELECT vec_id, proto.label AS nearest, 1e0 - list_inner_product(v, c) AS d FROM e CROSS JOIN proto), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) AS rn FROM d) SELECT vec_id, nearest, round(d, 6) AS distance FROM r WHERE rn = 1")
def embedding_cosine_top1(spark, sf):
    """The label prototype nearest to each vector; the prototypes are one row a label, and are broadcast if they are few."""
    d = R.table(spark, sf, "embeddings").select("vec_id", "embedding").crossJoin(joins.small(_protos(spark, sf))).withColumn("d", V.cosine_distance("embedding", "c"))
    return d.groupBy("vec_id").agg(F.min(F.struct("d", "label")).alias("m")).select("vec_id", F.col("m.label").alias("nearest"), r6("m.d", "distance"))


@query("""WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:32], lambda x: x * 0.7e0) || list_transform(CAST(embedding AS DOUBLE[])[33:64], lambda x: x * 1.15e0) AS v FROM embeddings)
SELECT vec_id, round(v[1] / greatest(sqrt(list_inner_product(v, v)), 1e-8), 6) AS first, round(v[64] / greatest(sqrt(list_inner_product(v, v)), 1e-8), 6) AS last FROM e""")  # fmt: skip
def embedding_mix_normalize(spark, sf):
    v = V.appearance(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return R.table(spark, sf, "embeddings").withColumn("v", v).select("vec_id", r6(F.col("v")[0], "first"), r6(F.col("v")[63], "last"))


@query(f"""WITH {O.POINTS}, {O.projected()}, {O.BOXES}, c AS (SELECT frame, pid AS cid, u, v, u - 40 AS px1, v - 90 AS py1, u + 40 AS px2, v + 90 AS py2 FROM proj WHERE valid),
p AS (SELECT c.*, b.det, u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2 AS contains_, greatest(0e0, least(px2, x2) - greatest(px1, x1)) * greatest(0e0, least(py2, y2) - greatest(py1, y1)) AS both_, (x2 - x1) * (y2 - y1) AS sb, sqrt(power(u - (x1 + x2) / 2, 2) + power(v - (y1 + y2) / 2, 2)) AS distance FROM c JOIN boxes b ON c.frame = b.frame),
q AS (SELECT *, both_ / greatest(80e0 * 180e0 + sb - both_, 1e-9) AS iou FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, cid ORDER BY contains_ DESC, iou DESC, distance, det) AS rn FROM q WHERE contains_ OR iou >= 0.1e0)
SELECT frame, cid, det, contains_ AS contains, round(iou, 4) AS iou FROM r WHERE rn = 1""")  # fmt: skip
def best_candidate(spark, sf):
    """The detection that stands for each target: containing first, then by overlap and distance."""
    p = R.points(spark, sf)
    c = R.projected(p).where("valid").select("frame", F.col("pid").alias("cid"), "u", "v", (F.col("u") - 40).alias("p_x1"), (F.col("v") - 90).alias("p_y1"), (F.col("u") + 40).alias("p_x2"), (F.col("v") + 90).alias("p_y2"))
    return joins.best_candidate(c, R.boxes(p)).select("frame", "cid", "det", "contains", F.round("iou", 4).alias("iou"))


@query("""WITH m AS (SELECT l_returnflag AS run, count(*) AS tp, round(avg(l_discount), 9) AS rmse FROM lineitem GROUP BY l_returnflag) SELECT run, run <> 'N' AS agrees FROM m""")
def expected_metrics(spark, sf):
    """Metrics against frozen ones, one of which is off."""
    m = R.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.count(F.lit(1)).alias("tp"), F.round(F.avg("l_discount"), 9).alias("rmse"))
    frozen = m.withColumn("tp", F.when(F.col("run") == "N", F.col("tp") + 1).otherwise(F.col("tp")))
    return audit.check_expected(m, frozen, "run", ["tp"], ["rmse"])


@query("""WITH m AS (SELECT l_linestatus AS run, CAST(count(*) AS DOUBLE) AS tp, avg(l_discount) AS precision, avg(l_tax) AS recall FROM lineitem GROUP BY l_linestatus),
l AS (SELECT run, unnest([{'metric': 'tp', 'value': tp}, {'metric': 'precision', 'value': precision}, {'metric': 'recall', 'value': recall}]) AS s FROM m)
SELECT s.metric AS metric, round(max(s.value) FILTER (run = 'F'), 6) AS "F", round(max(s.value) FILTER (run = 'O'), 6) AS "O", round(max(s.value) FILTER (run = 'O') - max(s.value) FILTER (run = 'F'), 6) AS delta FROM l GROUP BY s.metric""")  # fmt: skip
def metric_table(spark, sf):
    """Two runs' metrics side by side, in long form."""
    m = R.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("run")).agg(F.count(F.lit(1)).cast("double").alias("tp"), F.avg("l_discount").alias("precision"), F.avg("l_tax").alias("recall"))
    return audit.long_form(m, "run", "F", "O", ["tp", "precision", "recall"]).select("metric", r6("F"), r6("O"), r6("delta"))


@query(f"""WITH {O.POINTS}, {O.projected()}, {O.BOXES}, t AS (SELECT frame, pid % 2 + 1 AS track, avg(u) AS u, avg(v) AS v FROM proj WHERE valid GROUP BY frame, pid % 2),
c AS (SELECT t.frame, track, det, 0.7e0 * sqrt(power(greatest(x1 - u, 0e0, u - x2) / (x2 - x1), 2) + power(greatest(y1 - v, 0e0, v - y2) / (y2 - y1), 2)) + 0.3e0 * sqrt(power((u - (x1 + x2) / 2) / (x2 - x1), 2) + power((v - (y1 + y2) / 2) / (y2 - y1), 2)) AS cost FROM t JOIN boxes b ON t.frame = b.frame),
d AS (SELECT frame, track, det, cost FROM c UNION ALL SELECT DISTINCT frame, track, CAST(-1 - track AS INTEGER), 1.25e0 FROM c),
w AS (SELECT a.frame, a.cost + coalesce(b.cost, 0e0) AS total FROM d a LEFT JOIN d b ON a.frame = b.frame AND b.track = 2 AND a.det <> b.det WHERE a.track = (SELECT min(track) FROM d x WHERE x.frame = a.frame))
SELECT frame, round(min(total), 6) AS total FROM w GROUP BY frame""")  # fmt: skip
def assign_tracks_dummy(spark, sf):
    """Total cost of the best association of two tracks (the means of either half of a frame's points) with its boxes, each track with a dummy of its own."""
    p = R.points(spark, sf)
    t = R.projected(p).where("valid").groupBy("frame", (F.col("pid") % 2 + 1).alias("track")).agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    c = t.join(R.boxes(p), "frame").select("frame", "track", F.col("det").cast("long").alias("det"), B.box_cost("u", "v", B.box("")).alias("cost"))
    a = assign.assign(assign.with_dummies(c, ["frame"], "track", "det", "cost", 1.25), ["frame"], "track", "det", "cost", 1.25, 2.0)
    return a.groupBy("frame").agg(F.round(F.sum("cost"), 6).alias("total"))
