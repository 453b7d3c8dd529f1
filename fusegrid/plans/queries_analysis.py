"""Queries that explain and compare runs: stage traces, taxonomies, frozen rules, gates, cohorts, samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.functions import boxes as B
from fusegrid.functions import geometry as G
from fusegrid.functions import model as M
from fusegrid.functions import vectors as V
from fusegrid.operators import aggregates as A
from fusegrid.operators import assign, audit, joins, taxonomy, windows
from fusegrid.operators.selection import quantiles
from fusegrid.plans import queries_evaluation as E
from fusegrid.plans import queries_geometry as Q
from fusegrid.plans.registry import r6, registry
from fusegrid.plans.scratch import materialize
from fusegrid.sources import oracle as O
from fusegrid.sources import readers
from fusegrid.sources import relations as R

QUERIES, ORACLES, query = registry()

# the gated points with their flags, the production policy's decision, and their owners
_CANDIDATES = f"""{Q.FLAGGED}, cand AS (SELECT f.frame, f.pid, g.u, g.v, f.h, temporal_keep, NOT (near AND (f.z - f.h <= 0.28e0 OR f.z - f.h >= 1.9e0)) AS occ_keep, o.det AS owner
  FROM flagged f JOIN gated g ON f.frame = g.frame AND f.pid = g.pid LEFT JOIN owned o ON f.frame = o.frame AND f.pid = o.pid),
raws AS (SELECT b.frame, b.det, count(p.pid) AS raw FROM boxes b LEFT JOIN proj p ON p.frame = b.frame AND p.valid AND p.depth > 0 AND p.u BETWEEN x1 AND x2 AND p.v BETWEEN y1 AND y2 GROUP BY b.frame, b.det),
inbox AS (SELECT b.frame, b.det, c.*  EXCLUDE (frame), h BETWEEN 0.08e0 AND 2.15e0 AS tall, temporal_keep AND occ_keep AS kept FROM boxes b JOIN cand c ON c.frame = b.frame AND u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2),
counted AS (SELECT frame, det, count(*) FILTER (tall) AS post_height, count(*) FILTER (tall AND temporal_keep) AS post_temporal, count(*) FILTER (tall AND occ_keep) AS post_occupancy, count(*) FILTER (tall AND kept) AS post_both,
  count(*) FILTER (tall AND owner = det) AS owned_before, count(*) FILTER (tall AND kept AND owner = det) AS owned, count(*) FILTER (tall AND kept AND owner <> det) AS stolen, count(*) FILTER (NOT tall) AS height_removed FROM inbox GROUP BY frame, det),
trace AS (SELECT r.frame, r.det, raw, coalesce(post_height, 0) AS post_height, coalesce(post_temporal, 0) AS post_temporal, coalesce(post_occupancy, 0) AS post_occupancy, coalesce(post_both, 0) AS post_both,
  coalesce(owned_before, 0) AS owned_before, coalesce(owned, 0) AS owned, coalesce(stolen, 0) AS stolen, coalesce(height_removed, 0) AS height_removed FROM raws r LEFT JOIN counted c ON r.frame = c.frame AND r.det = c.det)"""


def _inside(spark, sf):
    """Boxes' points: a row for each point and box that contains it, with flags, the production policy's decision, and the point's owner.

    The owner is found among those rows, so points are numbered, projected and dealt to tasks once.
    """
    p = R.projected(R.points(spark, sf)).where(F.col("valid") & (F.col("depth") > 0))
    p = Q._near_and_prior(spark, sf, p).withColumn("gated", G.in_view("u", "v", "depth") & G.within("h", M.BROAD_HEIGHT))
    p = p.withColumn("occupancy_keep", audit.occupancy_keep(F.lit("LEGACY"), "z", "h", "near", "temporal_keep", F.lit(False)))
    return joins.with_owner(p.drop("x", "y", "z", "kx", "ky", "kz", "in_prior", "near"), R.boxes(R.points(spark, sf)), F.col("gated"))


def _trace(spark, sf):
    return taxonomy.stage_counts(_inside(spark, sf), R.boxes(R.points(spark, sf)))


@query(f"WITH {_CANDIDATES} SELECT * FROM trace")
def box_stage_trace(spark, sf):
    """Points of each box at each stage, whoever owns them, and those it owns."""
    return _trace(spark, sf)


@query(f"""WITH {_CANDIDATES}, h AS (SELECT frame, det, owner, count(*) AS n FROM inbox WHERE tall AND owner IS NOT NULL GROUP BY frame, det, owner)
SELECT frame, det, string_agg(owner || '=' || n, ';' ORDER BY owner) AS owners FROM h GROUP BY frame, det""")  # fmt: skip
def point_owners(spark, sf):
    """Which boxes own the points inside a box, as a histogram."""
    hit = _inside(spark, sf).where("owner is not null").where(G.within("h", M.CLASS_HEIGHT["PERSON"]))
    held = hit.groupBy("frame", "det", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("frame", "det").agg(A.histogram_map("owner", "n").alias("m"))
    return held.select("frame", "det", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ";").alias("owners"))


_REASONS = tuple(audit.RECOVERY_CAUSE)


@query(f"""WITH {_CANDIDATES}, s AS (SELECT *, CASE WHEN owned >= 3 THEN (frame + det) % 3 ELSE 0 END AS clusters, (frame + det) % 4 <> 1 AS selected, ([{", ".join(f"'{r}'" for r in _REASONS)}])[1 + frame % {3 * len(_REASONS)}] AS reason,
  (frame + det) % 5 <> 2 AS has_prediction, (frame * 7 + det * 3) % 40 / 1e1 AS sd, (frame * 11 + det) % 40 / 1e1 AS bd, (frame + det) % 3 AS br, frame % 4 = 0 AS pm, (frame + det) % 3 AS np FROM trace),
k AS (SELECT *, CASE WHEN reason = 'NO_METRIC_HISTORY' THEN 'E1_NO_HISTORY_SUPPORT' WHEN reason IN ('NO_OCCUPANCY_DELETED_COMPONENT', 'TOO_FEW_POINTS') THEN 'E2_RECOVERY_NO_VALID_COMPONENT' WHEN reason = 'HISTORY_MOTION_GATE_REJECT' THEN 'E3_RECOVERY_MOTION_GATE_REJECT'
  WHEN reason = 'NEIGHBOR_PERSON_COMPETITION' THEN 'E5_RECOVERY_NEIGHBOR_CONFLICT_REJECT' WHEN reason IS NOT NULL THEN 'E4_RECOVERY_COMPONENT_QUALITY_REJECT' END AS recovery FROM s)
SELECT CASE WHEN (frame + det) % 19 = 0 THEN 'A1_NO_PERSON_DETECTION' WHEN (frame + det) % 23 = 0 THEN 'A2_PERSON_BOX_GEOMETRY_MISMATCH' WHEN raw = 0 THEN 'B1_NO_RAW_PROJECTED_POINTS' WHEN raw < 3 THEN 'B2_RAW_LIDAR_TOO_SPARSE'
WHEN post_height < 3 THEN 'C_GEOMETRIC_OR_HEIGHT_GATE_REMOVAL' WHEN post_both < 3 THEN 'D_STATIC_SUPPRESSION_REMOVAL' WHEN recovery IS NOT NULL AND frame % 7 <> 0 THEN recovery WHEN owned >= 3 AND clusters = 0 THEN 'F_CLUSTERING_FAIL' WHEN owned < 3 AND stolen > 0 THEN 'H_POINT_OWNERSHIP_CONFLICT'
WHEN clusters > 0 AND NOT selected THEN 'G1_NO_COMPONENT_PASSED_SCORING' WHEN NOT has_prediction THEN coalesce(recovery, 'G1_NO_COMPONENT_PASSED_SCORING') WHEN sd > 1.5e0 AND bd <= 1.5e0 AND br > 1 THEN 'G3_CORRECT_COMPONENT_LOST_RANKING' WHEN sd > 1.5e0 AND bd <= 1.5e0 THEN 'G2_WRONG_COMPONENT_RANKED_FIRST'
WHEN pm THEN 'I2_PREDICTION_MATCHED_ANOTHER_GT' WHEN np > 1 THEN 'I3_DUPLICATE_OR_MERGED_DETECTION_COMPETITION' WHEN np = 1 THEN 'I4_GLOBAL_ASSIGNMENT_COMPETITION' ELSE 'I1_NEAREST_PREDICTION_OUTSIDE_GATE' END AS cause, count(*) AS n FROM k GROUP BY 1""")  # fmt: skip
def root_cause_ladder(spark, sf):
    """The primary cause of a miss at every box, from its stage trace and the decisions that followed."""
    e = F.expr
    reason = F.get(F.array(*map(F.lit, _REASONS)), (F.col("frame") % (3 * len(_REASONS))).cast("int"))
    t = _trace(spark, sf).withColumns({"clusters": F.when(F.col("owned") >= 3, (F.col("frame") + F.col("det")) % 3).otherwise(0), "reason": reason})
    cause = audit.miss_cause({
        "n_person": F.when(e("(frame + det) % 19 = 0"), 0).otherwise(1), "matched_box": e("(frame + det) % 23 <> 0"), **{c: F.col(c) for c in ("raw", "post_height", "post_both", "owned", "stolen", "clusters")},
        "selected": e("(frame + det) % 4 <> 1"), "recovery_reason": F.col("reason"), "recovery_accepted": e("frame % 7 = 0"), "has_prediction": e("(frame + det) % 5 <> 2"), "selected_distance": e("(frame * 7 + det * 3) % 40 / 10"),
        "best_distance": e("(frame * 11 + det) % 40 / 10"), "best_rank": e("(frame + det) % 3"), "prediction_matched": e("frame % 4 = 0"), "near_predictions": e("(frame + det) % 3"),
    })
    return t.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


# one target for each quarter of a frame's points, at their mean
_TARGETS = f"""{_CANDIDATES}, target AS (SELECT frame, pid % 4 AS gt, avg(x) AS tx, avg(y) AS ty, avg(z) AS tz FROM points GROUP BY frame, pid % 4),
{O.projected().replace('camera AS', 'tcamera AS').replace('rays AS', 'trays AS').replace('radial AS', 'tradial AS').replace('proj AS', 'tproj AS').replace('FROM points', 'FROM (SELECT frame, gt AS pid, tx AS x, ty AS y, tz AS z FROM target)').replace('FROM camera)', 'FROM tcamera)').replace('FROM rays)', 'FROM trays)').replace('FROM radial)', 'FROM tradial)')}"""


def _targets(spark, sf):
    t = R.points(spark, sf).groupBy("frame", F.pmod("pid", F.lit(4)).alias("gt")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return R.projected(t)


@query(f"""WITH {_TARGETS}, beside AS (SELECT t.frame, t.pid AS gt, b.det, row_number() OVER (PARTITION BY t.frame, t.pid ORDER BY round(abs((x1 + x2) / 2 - t.u), 6), b.det) AS rn FROM tproj t JOIN boxes b ON t.frame = b.frame AND t.valid AND t.depth > 0 AND t.u BETWEEN x1 AND x2 AND t.v BETWEEN y1 AND y2),
m AS (SELECT t.frame, t.gt, n.det, s.owned_before, s.owned FROM target t LEFT JOIN beside n ON t.frame = n.frame AND t.gt = n.gt AND rn = 1 LEFT JOIN trace s ON n.frame = s.frame AND n.det = s.det)
SELECT CASE WHEN det IS NULL THEN 'A_NO_PROJECTED_POINTS_OR_PERSON_BOX' WHEN owned_before < 3 THEN 'A_NO_PROJECTED_POINTS_IN_BOX' WHEN owned < 3 THEN 'B_SUPPRESSION_LEAVES_TOO_FEW_POINTS' WHEN (frame + det) % 6 = 0 THEN 'C_CLUSTERING_FAILS'
  WHEN (frame + det) % 5 = 0 THEN 'D_SHAPE_OR_QUALITY_GATE' WHEN frame % 2 = 0 THEN 'E_COMPONENT_ASSIGNMENT_FAILS' ELSE 'F_TRACKING_ASSOCIATION_FAILURE' END AS problem, count(*) AS n FROM m GROUP BY 1""")  # fmt: skip
def miss_taxonomy(spark, sf):
    """Why each target would be missed, from the box that contains it and is nearest to it sideways."""
    b = R.boxes(R.points(spark, sf))
    t = _targets(spark, sf)
    near = t.where("valid and depth > 0").join(b, "frame").where(B.inside("u", "v", B.box("")))
    near = near.groupBy("frame", "gt").agg(F.min(F.struct(F.round(F.abs((F.col("x1") + F.col("x2")) / 2 - F.col("u")), 6).alias("d"), "det"))["det"].alias("det"))
    m = t.select("frame", "gt").join(near, ["frame", "gt"], "left").join(_trace(spark, sf), ["frame", "det"], "left")
    stage = {"before": F.col("owned_before"), "after": F.col("owned"), "clusters": F.expr("(frame + det) % 6"), "fit": F.expr("(frame + det) % 5 <> 0")}
    return m.groupBy(taxonomy.target_miss(F.col("det").isNotNull(), stage, F.expr("frame % 2 = 0")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CANDIDATES} SELECT CASE WHEN owned_before < 3 THEN 'A_NO_PROJECTED_POINTS_IN_BOX' WHEN owned < 3 THEN 'B_SUPPRESSION_LEAVES_TOO_FEW_POINTS' WHEN (frame + det) % 6 = 0 THEN 'C_CLUSTERING_FAILS' WHEN (frame + det) % 5 = 0 THEN 'D_SHAPE_OR_QUALITY_GATE'
  ELSE 'E_COMPONENT_ASSIGNMENT_FAILS' END AS problem, count(*) AS n FROM trace WHERE NOT (owned >= 30 AND (frame + det) % 6 <> 0 AND (frame + det) % 5 <> 0) GROUP BY 1""")  # fmt: skip
def detection_miss_taxonomy(spark, sf):
    """Why boxes have no component."""
    t = _trace(spark, sf).where("not (owned >= 30 and (frame + det) % 6 <> 0 and (frame + det) % 5 <> 0)")
    stage = {"before": F.col("owned_before"), "after": F.col("owned"), "clusters": F.expr("(frame + det) % 6"), "fit": F.expr("(frame + det) % 5 <> 0")}
    return t.groupBy(taxonomy.stage_miss(stage, "E_COMPONENT_ASSIGNMENT_FAILS").alias("problem")).agg(F.count(F.lit(1)).alias("n"))


_G = M.GROUND_NORMAL
_H = f"(x * ({O.n(_G[0])}) + y * ({O.n(_G[1])}) + (z - 2e0) * ({O.n(_G[2])}) + {O.n(M.GROUND_D)})"


@query(f"""{E._MATCHED}, f AS (SELECT * FROM pred WHERE (frame, pred) NOT IN (SELECT (frame, pred) FROM hits)), base AS (SELECT * FROM f WHERE frame % 2 = 0),
k AS (SELECT f.*, {_H} AS h, EXISTS (SELECT 1 FROM pred o WHERE o.frame = f.frame AND o.pred <> f.pred AND sqrt(power(o.x - f.x, 2) + power(o.y - f.y, 2)) < 0.75e0) AS near_other,
  NOT EXISTS (SELECT 1 FROM base b WHERE b.frame = f.frame AND sqrt(power(b.x - f.x, 2) + power(b.y - f.y, 2)) < 0.25e0) AS incremental FROM f)
SELECT CASE WHEN (frame + pred) % 9 = 0 THEN 'neighbor_person_contamination' WHEN (frame + pred) % 7 = 0 THEN 'robot_contamination' WHEN h < 0.25e0 OR frame % 10 / 1e1 < 0.10e0 THEN 'wall_or_floor' WHEN pred % 3 / 2e0 > 0.9e0 AND h < 1.4e0 THEN 'furniture_or_static_structure'
  WHEN near_other THEN 'split_person' ELSE 'unknown' END AS kind, incremental, count(*) AS n FROM k GROUP BY 1, 2""")  # fmt: skip
def fp_taxonomy(spark, sf):
    """Kinds of predictions without a target, and whether an earlier run (here: the even frames) had them already."""
    p = R.predicted(spark, sf)
    f = p.join(E._hits(spark, sf), ["frame", "pred"], "left_anti")
    close = lambda rows, d, rule: (
        f.alias("f").join(rows.select("frame", F.col("pred").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy")).alias("r"), "frame").where(rule & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) < d)).select("frame", "pred").distinct()
    )
    k = f.join(close(p, 0.75, F.col("o") != F.col("pred")).withColumn("near_other", F.lit(True)), ["frame", "pred"], "left")
    k = k.join(close(f.where("frame % 2 = 0"), 0.25, F.lit(True)).withColumn("known", F.lit(True)), ["frame", "pred"], "left")
    h = G.ground_height("x", "y", F.col("z") - 2)
    kind = taxonomy.false_positive_kind(F.expr("(frame + pred) % 9 = 0"), F.expr("(frame + pred) % 7 = 0"), h, F.expr("pred % 3 / 2"), F.expr("frame % 10 / 10"), F.coalesce("near_other", F.lit(False)))
    return k.groupBy(kind.alias("kind"), F.col("known").isNull().alias("incremental")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TARGETS}, m AS (SELECT t.frame, t.pid AS gt, count(b.det) AS covering, count(CASE WHEN (t.frame + b.det) % 3 <> 0 THEN 1 END) AS measured, min(CASE WHEN (t.frame + b.det) % 3 <> 0 THEN (t.frame + b.det * 5 + t.pid) % 30 / 1e1 END) AS nearest
  FROM tproj t LEFT JOIN boxes b ON t.frame = b.frame AND t.valid AND t.u BETWEEN x1 AND x2 AND t.v BETWEEN y1 AND y2 GROUP BY t.frame, t.pid)
SELECT CASE WHEN covering = 0 THEN 'A_COCO_BOX_MISS_OR_PROJECTION_PROXY_MISMATCH' WHEN measured = 0 THEN 'B_BOX_PRESENT_NO_LIDAR_COMPONENT' WHEN nearest > 1.5e0 THEN 'C_COMPONENT_XYZ_OUTSIDE_1P5M_GATE' ELSE 'D_SHORT_TRACKER_OR_STATE_ASSOCIATION_FAILURE' END AS class, count(*) AS n FROM m GROUP BY 1""")  # fmt: skip
def fn_proxy_class(spark, sf):
    """Classes of misses after a run, from the boxes over a target and the positions that they have."""
    t = _targets(spark, sf)
    hit = t.where("valid").join(R.boxes(R.points(spark, sf)), "frame").where(B.inside("u", "v", B.box("")))
    has = F.expr("(frame + det) % 3 <> 0")
    c = hit.groupBy("frame", "gt").agg(F.count(F.lit(1)).alias("covering"), F.count_if(has).alias("measured"), F.min(F.when(has, F.expr("(frame + det * 5 + gt) % 30 / 10"))).alias("nearest"))
    m = t.select("frame", "gt").join(c, ["frame", "gt"], "left").fillna(0, ["covering", "measured"])
    return m.groupBy(taxonomy.proxy_class(F.col("covering"), F.col("measured"), F.col("nearest")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_SOURCE = "CASE WHEN (frame + pred) % 3 = 0 THEN 'RECOVERED_SUPPRESSED_COMPONENT' ELSE 'NORMAL_COMPONENT' END"


def _sourced(spark, sf):
    return R.predicted(spark, sf).withColumn("source", F.expr(_SOURCE))


@query(f"""{E._MATCHED}, s AS (SELECT *, {_SOURCE} AS source FROM pred UNION ALL SELECT frame, pred + 10, x + 0.3e0, y, z, 'RECOVERED_SUPPRESSED_COMPONENT' FROM pred WHERE frame % 4 = 0), held AS (SELECT h.frame, g.x, g.y, g.z FROM hits h JOIN s USING (frame, pred) JOIN gt g ON g.frame = h.frame AND g.gt = h.gt WHERE source = 'NORMAL_COMPONENT')
SELECT DISTINCT s.frame, s.pred FROM s JOIN held t ON s.frame = t.frame AND sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2) + power(s.z - t.z, 2)) <= 1.5e0 WHERE source = 'RECOVERED_SUPPRESSED_COMPONENT' AND (s.frame, s.pred) NOT IN (SELECT (frame, pred) FROM hits)""")  # fmt: skip
def duplicate_occupation(spark, sf):
    """Recovered predictions beside targets that ordinary ones have; in every fourth frame each prediction is recovered again."""
    p = _sourced(spark, sf)
    again = p.where("frame % 4 = 0").withColumns({"pred": F.col("pred") + 10, "x": F.col("x") + 0.3, "source": F.lit("RECOVERED_SUPPRESSED_COMPONENT")})
    return taxonomy.duplicate_occupations(p.union(again), R.truth(spark, sf), E._hits(spark, sf))


@query(f"""{E._MATCHED}, m AS (SELECT h.*, {_SOURCE} AS source FROM hits h), r AS (SELECT *, lag(gt) OVER (PARTITION BY pred ORDER BY frame) AS previous FROM m WHERE source <> 'NORMAL_COMPONENT')
SELECT (SELECT count(*) FROM r) AS recovered_matched, (SELECT count(*) FROM pred WHERE {_SOURCE} <> 'NORMAL_COMPONENT') - (SELECT count(*) FROM r) AS recovered_unmatched, (SELECT count(*) FROM r WHERE previous <> gt) AS neighbor_transitions""")  # fmt: skip
def recovered_matches(spark, sf):
    """Recovered predictions with and without a target, and how often a track's recovered target changes."""
    p = _sourced(spark, sf).where("source = 'RECOVERED_SUPPRESSED_COMPONENT'")
    m = E._hits(spark, sf).join(p.select("frame", "pred"), ["frame", "pred"], "left_semi")
    changed = windows.transitions(m, "pred", "frame", "gt").agg(F.count(F.lit(1)).alias("neighbor_transitions"))
    c = m.agg(F.count(F.lit(1)).alias("recovered_matched")).crossJoin(p.agg(F.count(F.lit(1)).alias("n"))).crossJoin(changed)
    return c.select("recovered_matched", (F.col("n") - F.col("recovered_matched")).alias("recovered_unmatched"), "neighbor_transitions")


@query(f"""{E._MATCHED} SELECT h.frame, h.pred, h.gt, {_SOURCE} AS source, round(sqrt(power(p.x - g.x, 2) + power(p.y - g.y, 2)), 6) AS error_xy, round(d, 6) AS error_xyz
FROM hits h JOIN pred p USING (frame, pred) JOIN gt g ON g.frame = h.frame AND g.gt = h.gt""".replace("(frame + pred)", "(h.frame + h.pred)"))  # fmt: skip
def matched_reference(spark, sf):
    """The cohort of matched targets, with their errors."""
    g = R.truth(spark, sf).select("frame", "gt", F.col("x").alias("gx"), F.col("y").alias("gy"))
    m = E._hits(spark, sf).join(_sourced(spark, sf), ["frame", "pred"]).join(g, ["frame", "gt"])
    return m.select("frame", "pred", "gt", "source", r6(F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy")), "error_xy"), r6("d", "error_xyz"))


@query(f"""{E._MATCHED}, j AS (SELECT coalesce(p.frame, g.frame) AS frame, CASE WHEN p.pred IS NULL THEN 'right' WHEN g.gt IS NULL THEN 'left' ELSE 'both' END AS side
  FROM (SELECT pred.frame, pred.pred, hits.gt AS m FROM pred LEFT JOIN hits ON pred.frame = hits.frame AND pred.pred = hits.pred) p FULL OUTER JOIN gt g ON p.frame = g.frame AND p.m = g.gt)
SELECT side, count(*) AS n FROM j GROUP BY side""")  # fmt: skip
def match_sides(spark, sf):
    """Matched rows, and those of either side without a match."""
    m = assign.full_outer_match(E._hits(spark, sf).select("frame", "pred", "gt"), R.predicted(spark, sf), R.truth(spark, sf), ["frame"], "pred", "gt")
    return m.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


# correspondence cases: one for each line item, training cases of matched (N) and missed (R) targets, and those to be told apart (A)
_CASE = """SELECT l_returnflag AS cohort, 0.5e0 + l_quantity / 4e1 AS width_ratio, 0.6e0 + l_discount * 8e0 AS height_ratio, l_tax * 5e0 AS iou, l_suppkey % 50 / 5e1 AS over_smaller, l_partkey % 100 / 1e2 AS center_norm, l_linenumber % 4 / 1e1 AS margin,
  l_partkey % 3 * 0.1e0 AS neighbor_iou, 0.3e0 + l_linenumber / 1e1 AS conf, l_quantity - 20e0 AS du, l_linenumber * 4e0 AS dv, l_partkey % 11 = 0 AS center_in_box, l_partkey % 13 = 0 AS box_center_in_proxy, l_suppkey % 17 = 0 AS proxy_at_border, l_suppkey % 7 = 0 AS box_at_border,
  l_suppkey % 5 = 0 AS closer_to_other, l_partkey % 7 = 0 AS close_neighbor, l_linenumber % 3 = 0 AS occluded, l_linenumber % 2 = 0 AS has_second FROM lineitem"""


@query(f"""WITH c AS ({_CASE}), z AS (SELECT *, greatest(abs(ln(width_ratio)), abs(ln(height_ratio))) AS sz FROM c),
t AS (SELECT greatest(0.03e0, quantile_cont(iou, 0.1)) AS r_iou, quantile_cont(center_norm, 0.9) AS r_center, quantile_cont(width_ratio, 0.1) AS r_w1, quantile_cont(width_ratio, 0.9) AS r_w2, quantile_cont(height_ratio, 0.1) AS r_h1, quantile_cont(height_ratio, 0.9) AS r_h2,
  greatest(0.2e0, quantile_cont(over_smaller, 0.1)) AS r_overlap, greatest(0.35e0, quantile_cont(sz, 0.95)) AS r_size, greatest(0.05e0, quantile_cont(margin, 0.1)) AS r_margin FROM z WHERE cohort = 'N'),
u AS (SELECT median(du) AS r_du, median(dv) AS r_dv, quantile_cont(du, 0.75) - quantile_cont(du, 0.25) AS r_du_iqr, quantile_cont(dv, 0.75) - quantile_cont(dv, 0.25) AS r_dv_iqr, greatest(avg(CAST(du >= 0 AS DOUBLE)), avg(CAST(du <= 0 AS DOUBLE))) >= 0.8e0 AS r_constant FROM z WHERE cohort = 'R'),
j AS (SELECT *, center_in_box OR box_center_in_proxy OR over_smaller >= r_overlap AS touches FROM z CROSS JOIN t CROSS JOIN u WHERE cohort = 'A')
SELECT CASE WHEN proxy_at_border OR (box_at_border AND touches) THEN 'TRUNCATED_OR_BORDER' WHEN has_second AND margin <= r_margin AND (closer_to_other OR close_neighbor OR (touches AND neighbor_iou > 0)) THEN 'AMBIGUOUS_CORRESPONDENCE'
  WHEN (center_in_box OR box_center_in_proxy OR iou >= r_iou OR (center_norm <= r_center AND width_ratio BETWEEN r_w1 AND r_w2 AND height_ratio BETWEEN r_h1 AND r_h2)) AND NOT occluded AND sz <= r_size THEN 'CRITERION_TOO_STRICT'
  WHEN r_constant AND abs(du - r_du) <= greatest(1e1, 1.5e0 * r_du_iqr) AND abs(dv - r_dv) <= greatest(1e1, 1.5e0 * r_dv_iqr) AND sz <= r_size AND NOT occluded THEN 'SYSTEMATIC_REGISTRATION' WHEN over_smaller >= r_overlap AND (sz > r_size OR occluded) THEN 'EXTENT_SEMANTICS'
  WHEN conf >= 0.5e0 AND over_smaller < 0.1e0 AND sz > 1.5e0 * r_size AND NOT occluded THEN 'EXTREME_DETECTION' ELSE 'UNRESOLVED' END AS subtype, count(*) AS n FROM j GROUP BY 1""")  # fmt: skip
def subtype_rules(spark, sf):
    """Subtypes of unmatched correspondences under limits frozen on the training cases."""
    R.table(spark, sf, "lineitem").createOrReplaceTempView("_cases")
    c = spark.sql(_CASE.replace("FROM lineitem", "FROM _cases").replace("e0", "D").replace("e1", "E1D"))
    rules = taxonomy.freeze_subtype_rules(c.where("cohort = 'N'"), c.where("cohort = 'R'"))
    return c.where("cohort = 'A'").crossJoin(F.broadcast(rules)).groupBy(taxonomy.subtype().alias("subtype")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT user_id, avg(value) AS f1, count(*) / 1e2 AS precision, count(*) FILTER (event_type = 'error') AS fp, stddev_pop(value) AS rmse, quantile_cont(value, 0.95) AS p95, count(*) FILTER (event_type = 'signup') % 2 AS duplicates, user_id % 2 AS transitions FROM events GROUP BY user_id),
b AS (SELECT avg(f1) AS f1, avg(precision) AS precision, avg(fp) AS fp, avg(rmse) AS rmse, avg(p95) AS p95 FROM v),
c AS (SELECT user_id, round(v.f1, 9) > round(b.f1, 9) AS c1, v.precision >= b.precision - 0.002e0 AS c2, v.fp - b.fp <= 5 AS c3, v.rmse <= b.rmse + 0.02e0 AS c4, v.p95 <= b.p95 + 0.05e0 AS c5, duplicates = 0 AS c6, transitions = 0 AS c7, v.p95 < 1e2 AS c8 FROM v CROSS JOIN b)
SELECT user_id, c1 AS f1_strictly_improves, c2 AS precision_within_0_002, c3 AS fp_increase_at_most_5, c4 AS xy_rmse_not_worse_by_0_02m, c5 AS xy_p95_not_worse_by_0_05m, c6 AS no_duplicate_gt_occupation, c7 AS no_neighbor_identity_transition, c8 AS time_p95_below_100ms,
  c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7 AND c8 AS passed FROM c""")  # fmt: skip
def promotion_gate(spark, sf):
    """Which variants (here: users) hold against the mean of all."""
    e = R.table(spark, sf, "events")
    v = e.groupBy("user_id").agg(F.avg("value").alias("f1"), (F.count(F.lit(1)) / 100).alias("precision"), F.count_if(F.col("event_type") == "error").alias("fp"), F.stddev_pop("value").alias("rmse"), A.quantile("value", 0.95).alias("p95"), (F.count_if(F.col("event_type") == "signup") % 2).alias("duplicates"))
    v = v.withColumns({"transitions": F.col("user_id") % 2, "time_p95": F.col("p95")})
    names = ("f1", "precision", "fp", "rmse", "p95")
    base = v.agg(*[F.avg(c).alias(f"b_{c}") for c in names])
    mine = {c: F.col(c) for c in (*names, "duplicates", "transitions", "time_p95")} | {"f1": F.round("f1", 9)}
    checks = taxonomy.promotion_checks(mine, {c: F.col(f"b_{c}") for c in names} | {"f1": F.round("b_f1", 9)})
    return audit.gate(v.crossJoin(F.broadcast(base)), checks).select("user_id", *checks, "passed")


@query("""SELECT l_returnflag AS k, coalesce(quantile_cont(CASE WHEN l_linenumber % 2 = 0 THEN l_discount END, 0.75), 0e0) AS p75, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
round(median(abs(l_extendedprice - 30000)), 6) AS median_abs, round(quantile_cont(abs(l_extendedprice - 30000), 0.95), 6) AS p95_abs, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr, coalesce(quantile_cont(CASE WHEN l_linenumber > 99 THEN l_tax END, 0.5), 0e0) AS none FROM lineitem GROUP BY 1""")  # fmt: skip
def other_distributions(spark, sf):
    """Percentiles that ignore nulls and default to 0, the wide and the absolute tables, and the interquartile range."""
    t = R.table(spark, sf, "lineitem").withColumn("d", F.col("l_extendedprice") - 30000)
    t = t.withColumns({"k": F.col("l_returnflag"), "even": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")), "never": F.when(F.col("l_linenumber") > 99, F.col("l_tax")), "a": F.abs("d")})
    more = {"mean": F.avg("_x"), "min": F.min("_x"), "max": F.max("_x")}
    g = quantiles(t, "l_extendedprice", {"median": 0.5, "p05": 0.05, "p95": 0.95, "p25": 0.25, "p75_": 0.75}, ["k"], more).withColumn("iqr", F.col("p75_") - F.col("p25"))
    for part in (quantiles(t, "a", {"median_abs": 0.5, "p95_abs": 0.95}, ["k"]).drop("n"), A.quantile_or_zero(t, "even", 0.75, ["k"], "p75"), A.quantile_or_zero(t, "never", 0.5, ["k"], "none")):
        g = g.join(part, "k")
    return g.select("k", "p75", F.round("mean", 4).alias("mean"), r6("median"), r6("p05"), r6("p95"), "min", "max", r6("median_abs"), r6("p95_abs"), r6("iqr"), "none")


@query(f"""WITH {_CANDIDATES}, n AS (SELECT max(frame) + 1 AS n FROM trace), s AS (SELECT t.*, CASE WHEN t.frame / n.n < 0.5e0 THEN 'TRAIN_FIT' WHEN t.frame / n.n < 0.6e0 THEN 'TRAIN_CALIBRATION' WHEN t.frame / n.n < 0.8e0 THEN 'VALIDATION' WHEN t.frame / n.n < 0.85e0 THEN 'EMBARGO' ELSE 'TEST' END AS split FROM trace t CROSS JOIN n)
SELECT split, count(*) AS n_boxes, round(count(*) FILTER (raw >= 3) / count(*), 6) AS raw_coverage, round(count(*) FILTER (owned >= 3) / count(*), 6) AS owned_coverage, round(sum(owned) / greatest(sum(owned_before), 1), 6) AS kept_share FROM s GROUP BY split""")  # fmt: skip
def coverage_ratios(spark, sf):
    """The share of boxes with enough points at a stage, and of points that suppression keeps, in each split."""
    t = _trace(spark, sf)
    n = t.agg((F.max("frame") + 1).alias("n"))
    t = t.crossJoin(F.broadcast(n)).withColumn("split", audit.split_of(F.col("frame"), F.col("n")))
    share = lambda c: F.round(F.count_if(F.col(c) >= M.MIN_COMPONENT_POINTS) / F.count(F.lit(1)), 6)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n_boxes"), share("raw").alias("raw_coverage"), share("owned").alias("owned_coverage"), F.round(A.ratio(F.sum("owned"), F.sum("owned_before")), 6).alias("kept_share"))


@query(f"""WITH {O.LOGS} SELECT track_id, count(*) AS n, count(*) FILTER (state = 'F') AS matched, count(*) FILTER (state = 'O') AS held, count(*) FILTER (state IS NULL) AS anonymous, round(count(*) FILTER (state IS NOT NULL) / count(*), 6) AS identified FROM lb GROUP BY track_id""")
def identity_sources(spark, sf):
    """How often each track's rows came from which source."""
    s = F.col("state")
    n = F.count(F.lit(1))
    return R.log(spark, sf, "b").groupBy("track_id").agg(n.alias("n"), F.count_if(s == "F").alias("matched"), F.count_if(s == "O").alias("held"), F.count_if(s.isNull()).alias("anonymous"), F.round(F.count_if(s.isNotNull()) / n, 6).alias("identified"))


@query("""WITH a AS (SELECT CASE WHEN l_orderkey % 10 < 6 THEN 'TRAIN_FIT' ELSE 'VALIDATION' END AS split, CASE l_returnflag WHEN 'A' THEN 'LEGACY' WHEN 'N' THEN 'V2' ELSE 'V7_BEST' END AS variant, l_quantity, l_linenumber, l_extendedprice FROM lineitem)
SELECT split, variant, CAST(sum(l_quantity) AS BIGINT) AS points, CAST(sum(l_linenumber) AS BIGINT) AS components, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM a GROUP BY split, variant""")  # fmt: skip
def variant_counters(spark, sf):
    """Counters and times of each variant, by its alias, in each split."""
    names = spark.createDataFrame([("A", "LEGACY"), ("N", "V2"), ("R", "V7_BEST")], "l_returnflag string, variant string")
    t = R.table(spark, sf, "lineitem").join(F.broadcast(names), "l_returnflag")
    g = t.groupBy(F.when(F.col("l_orderkey") % 10 < 6, "TRAIN_FIT").otherwise("VALIDATION").alias("split"), "variant")
    return g.agg(F.sum("l_quantity").cast("long").alias("points"), F.sum("l_linenumber").cast("long").alias("components"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(A.quantile("l_extendedprice", 0.95), 6).alias("p95"), F.round(A.quantile("l_extendedprice", 0.99), 6).alias("p99"))


@query(f"""WITH {O.BASE}, r AS (SELECT CASE WHEN frame % 10 < 6 THEN 'fit' ELSE 'hold' END AS split, (x1 + x2) / 2 - u AS du, (y1 + y2) / 2 - v AS dv FROM owned), h AS (SELECT unnest([{{'model': 'none', 'a': 0e0, 'b': 0e0}}, {{'model': 'inference', 'a': 64e0, 'b': 36e0}}, {{'model': 'display', 'a': 60e0, 'b': 17e0}}]) AS m),
s AS (SELECT m.model AS model, split, unnest([{{'axis': 'u', 'e': du - m.a}}, {{'axis': 'v', 'e': dv - m.b}}, {{'axis': 'radial', 'e': sqrt(power(du - m.a, 2) + power(dv - m.b, 2))}}]) AS x FROM r CROSS JOIN h)
SELECT model, split, x.axis AS axis, count(*) AS n, round(median(x.e), 4) AS median, round(median(abs(x.e)), 4) AS median_abs, round(quantile_cont(abs(x.e), 0.95), 4) AS p95_abs, round(sqrt(avg(x.e * x.e)), 4) AS rmse FROM s GROUP BY 1, 2, 3""")  # fmt: skip
def model_residuals(spark, sf):
    """Residuals of three shift models on either part: sideways, up and down, and together."""
    r = Q._owned(spark, sf).select(F.when(F.col("frame") % 10 < 6, "fit").otherwise("hold").alias("split"), ((F.col("x1") + F.col("x2")) / 2 - F.col("u")).alias("du"), ((F.col("y1") + F.col("y2")) / 2 - F.col("v")).alias("dv"))
    r = materialize(r, "model-residuals")
    models = spark.createDataFrame([("none", 0.0, 0.0), *[(k, *map(float, M.SHIFTS[k])) for k in ("inference", "display")]], "model string, a double, b double")
    s = r.crossJoin(F.broadcast(models)).select("model", "split", (F.col("du") - F.col("a")).alias("u"), (F.col("dv") - F.col("b")).alias("v")).withColumn("radial", F.hypot("u", "v"))
    keys = ["model", "split", "axis"]
    long = s.unpivot(["model", "split"], ["u", "v", "radial"], "axis", "e").withColumn("m", F.abs("e"))
    signed = quantiles(long, "e", {"median": 0.5}, keys, {"rmse": F.sqrt(F.avg(F.col("_x") * F.col("_x")))})
    g = signed.join(quantiles(long, "m", {"median_abs": 0.5, "p95_abs": 0.95}, keys).drop("n"), keys)
    return g.select(*keys, "n", *[F.round(c, 4).alias(c) for c in ("median", "median_abs", "p95_abs", "rmse")])


@query(f"WITH {O.POINTS}, {O.BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, det) AS rn FROM boxes) SELECT frame, det, round(conf, 6) AS conf FROM r WHERE rn = 1")
def primary_robot(spark, sf):
    """The detection of greatest confidence in each frame."""
    best = F.max(F.struct("conf", (-F.col("det")).alias("d")))
    return R.boxes(R.points(spark, sf)).groupBy("frame").agg(best.alias("m")).select("frame", (-F.col("m.d")).alias("det"), r6("m.conf", "conf"))


@query(f"""WITH {O.LOGS}, u AS (SELECT track_id, state, frame, 0 AS recovered FROM la UNION ALL SELECT track_id, state, frame, 1 FROM lb), r AS (SELECT *, row_number() OVER (PARTITION BY track_id, state ORDER BY frame DESC, recovered DESC) AS rn FROM u WHERE state IS NOT NULL) SELECT track_id, state, frame, recovered = 1 AS recovered FROM r WHERE rn = 1""")
def best_duplicate_owner(spark, sf):
    """Of the rows that claim one owner the latest stays, a recovered one before another of the same time."""
    a, b = (R.log(spark, sf, k).where("state is not null").select("track_id", "state", "frame", F.lit(k == "b").alias("recovered")) for k in "ab")
    return a.union(b).groupBy("track_id", "state").agg(F.max(F.struct("frame", "recovered")).alias("m")).select("track_id", "state", "m.*")


@query(f"{E._MATCHED}, f AS (SELECT frame, count(*) AS n FROM gt WHERE (frame, gt) NOT IN (SELECT (frame, gt) FROM hits) GROUP BY frame) SELECT frame, n FROM f ORDER BY n DESC, frame LIMIT 12")
def top_risk_frames(spark, sf):
    """The twelve frames of most misses: a report of fixed length."""
    m = R.truth(spark, sf).join(E._hits(spark, sf), ["frame", "gt"], "left_anti")
    return m.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "frame").limit(12)


_TOKENS = ("URGENT", "HIGH", "MEDIUM")


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS frame, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 0 WHEN contains(o_orderpriority, 'HIGH') THEN 1 WHEN contains(o_orderpriority, 'MEDIUM') THEN 2 ELSE 3 END AS rank FROM orders),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, frame) AS rn FROM r) SELECT k, frame, rank FROM d WHERE rn = 1 ORDER BY rank, frame LIMIT 30""")  # fmt: skip
def priority_cases(spark, sf):
    """Thirty cases to look at, one a key, by the first priority token that they have: a report of fixed length."""
    o = R.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("frame"), windows.token_rank("o_orderpriority", _TOKENS).alias("rank"))
    return o.groupBy("k").agg(F.min(F.struct("rank", "frame")).alias("m")).select("k", "m.frame", "m.rank").orderBy("rank", "frame").limit(30)


@query(f"WITH {O.POINTS}, s AS (SELECT frame, pid FROM points WHERE pid % 10 = 0) SELECT frame, count(*) AS n, max(pid) AS last FROM s GROUP BY frame")
def stride_sample(spark, sf):
    """Every tenth point of a frame, for display: the operator is a sample."""
    return windows.stride(R.points(spark, sf), "pid", 10).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.max("pid").alias("last"))


@query(f"WITH {O.BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, pid) AS rn FROM owned) SELECT frame, pid, det FROM r WHERE rn = 1 ORDER BY frame LIMIT 16")
def first_per_frame_limit(spark, sf):
    """The first row of a frame, of the first sixteen frames: a report of fixed length."""
    return windows.first_per_key(Q._owned(spark, sf), ["frame"], [F.desc("conf"), F.col("pid")]).orderBy("frame").limit(16).select("frame", "pid", "det")


@query(f"""{E._MATCHED}, v AS (SELECT gt.*, frame % 9 <> 0 AS gt_valid FROM gt), s AS (SELECT * FROM v WHERE gt_valid AND frame % 2 = 0) SELECT count(*) AS n, count(DISTINCT frame) AS frames, count(*) = 3 * count(DISTINCT frame) AS complete FROM s""")
def truth_scan(spark, sf):
    """The valid targets of the frames in scope, and whether every frame has all of its own."""
    t = R.truth(spark, sf).withColumn("gt_valid", F.when(F.col("frame") % 9 != 0, "True").otherwise("False"))
    scope = R.truth(spark, sf).where("frame % 2 = 0").select("frame").distinct()
    return readers.valid_targets(t, scope).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame").alias("frames"), (F.count(F.lit(1)) == F.countDistinct("frame") * 3).alias("complete"))


@query("""SELECT count(*) AS messages, count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)) AS signatures, round(max(abs(l_discount - 0.05e0)), 6) AS max_error FROM lineitem""")
def camera_info_scan(spark, sf):
    """Messages, distinct payloads among them, and the greatest deviation from a constant."""
    t = R.table(spark, sf, "lineitem")
    return readers.payload_signatures(t, ["l_returnflag", "l_linestatus", "l_linenumber"], {"l_discount": 0.05})


@query(f"""WITH {O.events('click', 'l')}, {O.events('view', 'v')}, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM l), s AS (SELECT * FROM n WHERE i IN (SELECT CAST(round_even(j * (n - 1) / 19e0, 0) AS BIGINT) FROM (SELECT unnest(range(20)) AS j))),
d AS (SELECT s.idx, s.ts - v.ts AS delta FROM s ASOF JOIN v ON s.ts >= v.ts) SELECT count(*) AS n, round(avg(delta), 2) AS mean, median(delta) AS median, CAST(max(delta) AS BIGINT) AS max FROM d""")  # fmt: skip
def sampled_sync_deltas(spark, sf):
    """How far back the images of twenty evenly spaced scans are: the operator is a sample."""
    scans = windows.even_sample_of_all(R.events(spark, sf, "click"), ["ts", "idx"], 20)
    d = joins.asof_latest(scans, R.events(spark, sf, "view")).withColumnRenamed("age", "delta")
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 2).alias("mean"), F.median("delta").alias("median"), F.max("delta").alias("max"))


@query(f"""WITH {O.POINTS}, {O.BOXES}, k AS (SELECT frame, det, CASE det WHEN 3 THEN 'dog' ELSE 'person' END AS name, conf FROM boxes) SELECT frame, count(*) AS n, round(max(conf), 6) AS conf FROM k WHERE name = 'person' AND conf >= 0.3e0 GROUP BY frame""")
def class_filter(spark, sf):
    """The detections of the one class that is asked for."""
    b = R.boxes(R.points(spark, sf)).withColumn("class_id", F.when(F.col("det") == 3, 16).otherwise(0))
    return windows.of_class(b, {0: "person", 16: "dog"}, "person", "class_id").where("conf >= 0.3").groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("conf"), 6).alias("conf"))


@query(f"{Q._SCORED}, p AS (SELECT s.*, hspan BETWEEN 0.1e0 AND 1.1e0 AND vspan BETWEEN 0.1e0 AND 2.2e0 AS plausible, u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2 AS inside FROM (SELECT *, {Q._SCORE} AS sc FROM proj2 WHERE valid) s) SELECT frame, det, label, n FROM p WHERE inside AND plausible AND round(sc, 9) <= 1.25e0")
def quality_guard(spark, sf):
    """Components inside their box, of a person's size, and of a good score."""
    c = Q._scored(spark, sf)
    return c.where(B.quality_guard(B.inside("u", "v", B.box("")), B.plausible("hspan", "vspan"), F.col("score"))).select("frame", "det", "label", "n")


_RV = (0.02, -0.01, 0.3)


@query(f"""WITH {O.POINTS}, k AS (SELECT sqrt({'+'.join(f'power({O.n(c)}, 2)' for c in _RV)}) AS a), r AS (SELECT frame, pid, x, y, z, cos(a) AS c, sin(a) AS s, {O.n(_RV[0])} / a AS kx, {O.n(_RV[1])} / a AS ky, {O.n(_RV[2])} / a AS kz FROM points CROSS JOIN k),
d AS (SELECT *, kx * x + ky * y + kz * z AS dot FROM r)
SELECT frame, pid, round(x * c + (ky * z - kz * y) * s + kx * dot * (1 - c) + 0.1e0, 6) AS rx, round(y * c + (kz * x - kx * z) * s + ky * dot * (1 - c) - 0.2e0, 6) AS ry, round(z * c + (kx * y - ky * x) * s + kz * dot * (1 - c) + 0.05e0, 6) AS rz FROM d""")  # fmt: skip
def rotation_vector(spark, sf):
    """Points moved by a small rotation vector and a shift."""
    r = G.rotated("x", "y", "z", _RV, (0.1, -0.2, 0.05))
    return R.points(spark, sf).select("frame", "pid", *[r6(e, f"r{c}") for c, e in zip("xyz", r, strict=True)])


@query("SELECT l_returnflag AS run, count(*) AS tp, round(avg(l_discount), 6) AS xy_rmse, round(max(l_discount), 6) AS xy_p95, round(avg(l_tax), 6) AS xyz_rmse FROM lineitem GROUP BY 1")
def flattened_metrics(spark, sf):
    """Nested metrics as columns of their own, by prefix; other nested values go."""
    m = R.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.count(F.lit(1)).alias("tp"), F.struct(F.round(F.avg("l_discount"), 6).alias("rmse"), F.round(F.max("l_discount"), 6).alias("p95")).alias("xy"), F.struct(F.round(F.avg("l_tax"), 6).alias("rmse")).alias("xyz"), F.struct(F.lit(1).alias("a")).alias("config"))
    return A.flattened(m, ["xy", "xyz"])


@query(f"""WITH {_TARGETS}, px AS (SELECT frame, pid AS gt, u, v, u - 40 AS a1, v - 90 AS b1, u + 40 AS a2, v + 90 AS b2 FROM tproj WHERE valid), j AS (SELECT px.*, b.det, x1, y1, x2, y2, greatest(0e0, least(a2, x2) - greatest(a1, x1)) * greatest(0e0, least(b2, y2) - greatest(b1, y1)) AS both_,
  (a2 - a1) * (b2 - b1) AS sa, (x2 - x1) * (y2 - y1) AS sb FROM px JOIN boxes b USING (frame))
SELECT frame, gt, det, round((x1 + x2) / 2 - u, 4) AS du, round((y1 + y2) / 2 - v, 4) AS dv, round(80e0 / (x2 - x1), 6) AS width_ratio, round(180e0 / (y2 - y1), 6) AS height_ratio, round(both_ / greatest(sa + sb - both_, 1e-9), 6) AS iou, round(both_ / greatest(least(sa, sb), 1e-9), 6) AS over_smaller,
  u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2 AS center_in_box, (x1 + x2) / 2 BETWEEN a1 AND a2 AND (y1 + y2) / 2 BETWEEN b1 AND b2 AS box_center_in_proxy, a1 <= 0 OR b1 <= 0 OR a2 >= 1279 OR b2 >= 719 AS proxy_at_border, CASE WHEN y2 - y1 < 100 THEN 'small' WHEN y2 - y1 < 250 THEN 'medium' ELSE 'large' END AS size,
  round(1e0 - both_ / greatest(sa + sb - both_, 1e-9) + 0.55e0 * sqrt(power((u - (x1 + x2) / 2) / (x2 - x1), 2) + power((v - (y1 + y2) / 2) / (y2 - y1), 2)) + 0.2e0 * abs(ln(80e0 / (x2 - x1))) + 0.2e0 * abs(ln(180e0 / (y2 - y1))), 6) AS cost FROM j""")  # fmt: skip
def case_metrics(spark, sf):
    """How each target's proxy box lies beside each box of its frame."""
    t = _targets(spark, sf).where("valid").select("frame", "gt", "u", "v", (F.col("u") - 40).alias("p_x1"), (F.col("v") - 90).alias("p_y1"), (F.col("u") + 40).alias("p_x2"), (F.col("v") + 90).alias("p_y2"))
    j = t.join(R.boxes(R.points(spark, sf)), "frame")
    m = B.case_metrics("u", "v", B.box("p_"), B.box(""))
    rounded = {k: F.round(c, 4 if k in ("du", "dv") else 6) if k in ("du", "dv", "width_ratio", "height_ratio", "iou", "over_smaller", "cost") else c for k, c in m.items()}
    return j.select("frame", "gt", "det", *[c.alias(k) for k, c in rounded.items()])


@query(f"""WITH {O.events('click', 'l')}, {O.events('view', 'v')}, d AS (SELECT l.idx, l.ts - v.ts AS age FROM l ASOF JOIN v ON l.ts >= v.ts)
SELECT count(*) FILTER (age <= 35000000) AS within, count(*) FILTER (age > 35000000) AS too_old, count(*) FILTER (age + 1 <= 35000000) AS within_less_one, CAST(0 AS BIGINT) AS future FROM d""")  # fmt: skip
def asof_tolerance_boundary(spark, sf):
    """Ages of the images of scans against a limit that counts as inside, and that none is from the future."""
    d = joins.asof_latest(R.events(spark, sf, "click"), R.events(spark, sf, "view"))
    state = G.age_state("age", 35_000_000)
    c = d.withColumns({"s": state, "less": G.age_state(F.col("age") + 1, 35_000_000)})
    return c.agg(F.count_if(F.col("s") == "within").alias("within"), F.count_if(F.col("s") == "too_old").alias("too_old"), F.count_if(F.col("less") == "within").alias("within_less_one"), F.count_if(F.col("s") == "future").alias("future"))


@query(f"""WITH {O.MEASUREMENTS}, {O.events('view', 'v')}, d AS (SELECT v.idx, track, v.ts - m.t AS horizon FROM v ASOF JOIN (SELECT max(track) AS track, t FROM measurements GROUP BY t) m ON v.ts >= m.t)
SELECT horizon <= 180000000 AS fresh, count(*) AS n FROM d GROUP BY 1""")  # fmt: skip
def freshness(spark, sf):
    """Images by whether the latest measurement is recent enough; the limit is inside, and later measurements are not seen."""
    m = R.measurements(spark, sf).groupBy(F.col("t").alias("ts")).agg(F.max("track").alias("idx"))
    d = joins.asof_latest(R.events(spark, sf, "view"), m)
    return d.groupBy(G.fresh("age", 180_000_000).alias("fresh")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{E._EMB}, c AS (SELECT vec_id // 2 AS frame, vec_id % 2 AS cand, proto.label, 1e0 - list_inner_product(v, c) AS d FROM e CROSS JOIN proto),
w AS (SELECT a.frame, a.label AS l0, b.label AS l1, a.d AS d0, b.d AS d1, row_number() OVER (PARTITION BY a.frame ORDER BY a.d + b.d, a.label) AS rn FROM c a JOIN c b ON a.frame = b.frame AND a.cand = 0 AND b.cand = 1 AND a.label <> b.label)
SELECT frame, CAST(0 AS BIGINT) AS cand, l0 AS label, round(d0, 6) AS d FROM w WHERE rn = 1 AND d0 <= 0.9e0 UNION ALL SELECT frame, 1, l1, round(d1, 6) FROM w WHERE rn = 1 AND d1 <= 0.9e0""")  # fmt: skip
def assignment_identity(spark, sf):
    """New identities: the candidates of a frame against all prototypes, none of which anybody has, by looks."""
    e = R.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("frame"), (F.col("vec_id") % 2).alias("cand"), "embedding")
    c = e.crossJoin(joins.small(E._protos(spark, sf))).withColumn("d", V.cosine_distance("embedding", "c"))
    return assign.assign(c, ["frame"], "cand", "label", "d", None, 0.9).select("frame", "cand", "label", r6("d"))


@query("""WITH r AS (SELECT o_custkey AS frame, o_orderkey, o_orderstatus <> 'P' AS processed, o_orderkey % 3 <> 0 AS fresh FROM orders), k AS (SELECT frame, max(o_orderkey) AS o FROM r WHERE processed AND fresh GROUP BY frame)
SELECT k.frame, k.o * 4 + i AS track, round(k.o % 100 + i / 2e0, 6) AS x FROM k CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) WHERE (k.o + i) % 4 <> 0""")  # fmt: skip
def log_predictions_extract(spark, sf):
    """Predictions out of a run's log: the last processed row of a frame with a new scan, one row for each person with a position."""
    i = F.array(*[F.lit(k) for k in range(3)])
    person = F.transform(i, lambda k: F.struct((F.col("o_orderkey") * 4 + k).alias("track_id"), ((F.col("o_orderkey") + k) % 4 != 0).alias("xyz_valid"), F.when(k > 0, F.array(F.col("o_orderkey") % 100 + k / 2, F.lit(0.0), F.lit(0.0))).alias("position_xyz"), (F.col("o_orderkey") % 100 + k / 2).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    detail = F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.col("o_custkey").alias("lidar_frame_id")))
    log = R.table(spark, sf, "orders").select((F.col("o_orderstatus") != "P").alias("processed"), (F.col("o_orderkey") % 3 != 0).alias("new_lidar_update"), detail.alias("lidar_update_detail"), F.col("o_custkey").alias("latest_lidar_frame_id"), person.alias("persons"), F.col("o_orderkey").alias("rgb_frame_id"))
    return readers.predictions(log).select("frame", F.col("track_id").alias("track"), r6("x"))


@query(f"WITH {O.LOGS} SELECT track_id, CAST(min(frame) AS BIGINT) AS birth, CAST(max(frame) AS BIGINT) AS last, CAST(max(frame) - min(frame) + 1 AS BIGINT) AS lifetime FROM la GROUP BY track_id")
def track_lifetimes(spark, sf):
    return windows.track_lifetimes(R.log(spark, sf, "a"), "track_id", "frame")


@query(f"""WITH {O.MEASUREMENTS}, d AS (SELECT track, t, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM measurements WINDOW w AS (PARTITION BY track ORDER BY t, event_id)), c AS (SELECT quantile_disc(t, 0.5) AS cut FROM measurements),
f AS (SELECT step FROM d CROSS JOIN c WHERE t <= cut AND step IS NOT NULL), m AS (SELECT median(step) AS m, count(*) AS n, quantile_cont(step, 0.9) AS p90, quantile_cont(step, 0.99) AS p99 FROM f), a AS (SELECT median(abs(step - m)) AS mad FROM f CROSS JOIN m)
SELECT n, round(least(p99, greatest(m + 3 * 1.4826e0 * mad, p90)), 6) AS "limit" FROM m CROSS JOIN a""")  # fmt: skip
def frozen_thresholds(spark, sf):
    """The limit of a track's steps, learnt on the first half of the time only."""
    m = R.measurements(spark, sf)
    w = W.partitionBy("track").orderBy("t", "event_id")
    d = m.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    # times are whole and far below 2**53, so the middle of the lower and upper median is at or after the lower one, and before the next time
    cut = quantiles(m, "t", {"cut": 0.5}).select("cut")
    fit = d.crossJoin(F.broadcast(cut)).where("t <= cut and step is not null").withColumn("all", F.lit(1))
    return A.robust_limit(fit, "step", ["all"]).select("n", r6("limit"))
