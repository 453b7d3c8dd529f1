"""Queries from points to measurements: projection, gates, priors, ownership, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusegrid.functions import boxes as B
from fusegrid.functions import geometry as G
from fusegrid.functions import model as M
from fusegrid.operators import aggregates as A
from fusegrid.operators import audit, cluster, joins, windows
from fusegrid.plans.registry import r6, registry
from fusegrid.plans.scratch import materialize
from fusegrid.sources import oracle as O
from fusegrid.sources import relations as R

QUERIES, ORACLES, query = registry()
n = O.n


def _gated(spark, sf):
    p = R.projected(R.points(spark, sf))
    return p.where(F.col("valid") & G.in_view("u", "v", "depth") & G.within("h", M.BROAD_HEIGHT))


def _owned(spark, sf):
    return joins.owners(_gated(spark, sf), R.boxes(R.points(spark, sf)))


_SCORE = f"""sqrt(power((u - (x1 + x2) / 2) / greatest(x2 - x1, 1e0), 2) + power((v - (y1 + greatest(y2 - y1, 1e0) * 0.54e0)) / greatest(y2 - y1, 1e0), 2))
  + (greatest(0e0, 0.1e0 - hspan) + greatest(0e0, 0.1e0 - vspan)) * 0.35e0 + (greatest(0e0, hspan - 1.1e0) + greatest(0e0, vspan - 2.2e0) * 0.5e0) * 0.45e0 - ln(1e0 + n) * 0.055e0"""


def _center_projection(source: str) -> str:
    """CTEs that project the centres cx, cy, cz of a relation."""
    return O.projected().replace("FROM points", f"FROM (SELECT *, cx AS x, cy AS y, cz AS z FROM {source})").replace("camera AS (SELECT *,", "camera AS (SELECT * EXCLUDE (cx, cy, cz),").replace("SELECT frame, pid, x, y, z, valid,", "SELECT * EXCLUDE (cx, cy, cz, a, b, r2), ")


@query(f"""WITH {O.BASE},
centers AS (SELECT frame, det, count(*) AS n, (quantile_cont(x, 0.05) + quantile_cont(x, 0.95)) / 2 AS cx, (quantile_cont(y, 0.05) + quantile_cont(y, 0.95)) / 2 AS cy,
  (quantile_cont(z, 0.05) + quantile_cont(z, 0.95)) / 2 AS cz, greatest(max(x) - min(x), max(y) - min(y)) AS hspan, max(z) - min(z) AS vspan FROM owned GROUP BY frame, det HAVING count(*) >= 3)
SELECT frame, det, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(hspan, 6) AS hspan, round(vspan, 6) AS vspan FROM centers""")  # fmt: skip
def frustum_measurements(spark, sf):
    """Points owned by each person box, their robust centre and spans: a measurement for each box with three points."""
    g = _owned(spark, sf).groupBy("frame", "det").agg(F.count(F.lit(1)).alias("n"), *[A.robust_center(c).alias(f"c{c}") for c in "xyz"], F.greatest(A.span("x"), A.span("y")).alias("hspan"), A.span("z").alias("vspan"))
    return g.where("n >= 3").select("frame", "det", "n", *[r6(c) for c in ("cx", "cy", "cz", "hspan", "vspan")])


@query(f"WITH {O.POINTS} SELECT frame, pid, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in zip(("cx", "cy", "cz"), O.rigid(M.OPTICAL_FROM_ANNOTATED), strict=True)) + " FROM points")
def rigid_transform(spark, sf):
    c = G.rigid("x", "y", "z", M.OPTICAL_FROM_ANNOTATED)
    return R.points(spark, sf).select("frame", "pid", *[r6(e, k) for k, e in zip(("cx", "cy", "cz"), c, strict=True)])


@query(f"WITH {O.POINTS}, {O.projected('physical')} SELECT frame, pid, valid, round(u, 4) AS u, round(v, 4) AS v, round(depth, 6) AS depth FROM proj")
def camera_projection(spark, sf):
    p = R.projected(R.points(spark, sf), "physical")
    return p.select("frame", "pid", "valid", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), r6("depth"))


_H = f"(x * ({n(M.GROUND_NORMAL[0])}) + y * ({n(M.GROUND_NORMAL[1])}) + z * ({n(M.GROUND_NORMAL[2])}) + {n(M.GROUND_D)})"
_LEN = n(sum(c * c for c in M.GROUND_NORMAL) ** 0.5)


@query(f"WITH {O.POINTS} SELECT frame, pid, round({_H}, 6) AS h, round({_H} / {_LEN}, 6) AS h_normalized, round(-(x * ({n(M.GROUND_NORMAL[0])}) + y * ({n(M.GROUND_NORMAL[1])}) + {n(M.GROUND_D)}) / {n(M.GROUND_NORMAL[2])}, 6) AS ground_z FROM points")
def ground_height(spark, sf):
    return R.points(spark, sf).select("frame", "pid", r6(G.ground_height("x", "y", "z"), "h"), r6(G.ground_height("x", "y", "z", normalized=True), "h_normalized"), r6(G.ground_z("x", "y"), "ground_z"))


@query(f"""WITH {O.POINTS}, c AS (SELECT frame, pid, x + i * 0.6e0 * cos(a) - j * 0.4e0 * sin(a) AS qx, y + i * 0.6e0 * sin(a) + j * 0.4e0 * cos(a) AS qy, z + k * 1.7e0 AS qz
  FROM (SELECT *, pid % 7 / 7e0 AS a FROM points) CROSS JOIN (SELECT unnest([-0.5e0, 0.5e0]) AS i) CROSS JOIN (SELECT unnest([-0.5e0, 0.5e0]) AS j) CROSS JOIN (SELECT unnest([-0.5e0, 0.5e0]) AS k)),
{O.projected().replace('FROM points', 'FROM (SELECT frame, pid, qx AS x, qy AS y, qz AS z FROM c)')}
SELECT frame, pid, CAST(count(*) FILTER (valid) AS BIGINT) AS n_valid, round(min(u), 4) AS x1, round(min(v), 4) AS y1, round(max(u), 4) AS x2, round(max(v), 4) AS y2 FROM proj GROUP BY frame, pid HAVING count(*) FILTER (valid) >= 2""")  # fmt: skip
def cuboid_proxy_box(spark, sf):
    """The pixel box of each point's person-sized cuboid, from its projected corners."""
    p = R.points(spark, sf).withColumn("yaw", F.pmod("pid", F.lit(7)) / 7)
    c = p.select("frame", "pid", F.explode(G.corners("x", "y", "z", F.lit(0.6), F.lit(0.4), F.lit(1.7), "yaw")).alias("c")).select("frame", "pid", "c.*")
    g = R.projected(c).groupBy("frame", "pid").agg(F.count_if("valid").alias("n_valid"), *[F.round(f(c), 4).alias(k) for k, f, c in (("x1", F.min, "u"), ("y1", F.min, "v"), ("x2", F.max, "u"), ("y2", F.max, "v"))])
    return g.where("n_valid >= 2")


@query(f"""WITH {O.POINTS}, o AS (SELECT frame, pid % 4 AS obj, CAST(sum(CAST(x AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS x, CAST(sum(CAST(y AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS y FROM points GROUP BY frame, pid % 4),
c AS (SELECT frame, obj, s, t, x + 0.25e0 * ca AS vx, y + 0.25e0 * sa AS vy, -(x * ({n(M.GROUND_NORMAL[0])}) + y * ({n(M.GROUND_NORMAL[1])}) + {n(M.GROUND_D)}) / {n(M.GROUND_NORMAL[2])} + t * 1.7e0 AS vz
  FROM o CROSS JOIN (VALUES {", ".join(f"({s}, {n(ca)}, {n(sa)})" for s, (ca, sa) in enumerate(G.circle(12)))}) AS r (s, ca, sa) CROSS JOIN (SELECT unnest([0, 1]) AS t))
SELECT frame, obj, CAST(t * 12 + s AS INTEGER) AS vertex, round(vx, 9) AS vx, round(vy, 9) AS vy, round(vz, 9) AS vz FROM c""")  # fmt: skip
def cylinder_vertices(spark, sf):
    """Display cylinders of a frame's objects, which stand at the means of the quarters of its points.

    Nine places: a mean of 32 points has up to seven, so no value lies at a half.
    """
    o = R.points(spark, sf).groupBy("frame", (F.col("pid") % 4).alias("obj")).agg(A.exact_mean("x").alias("x"), A.exact_mean("y").alias("y"))
    return o.select("frame", "obj", F.posexplode(G.cylinder("x", "y")).alias("vertex", "c")).select("frame", "obj", "vertex", *[F.round(f"c.{c}", 9).alias(f"v{c}") for c in "xyz"])


@query(f"WITH {O.POINTS}, {O.projected()}, {O.GATED} SELECT frame, pid, round(u, 4) AS u, round(v, 4) AS v, round(h, 6) AS h FROM gated")
def view_height_gates(spark, sf):
    return _gated(spark, sf).select("frame", "pid", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), r6("h"))


@query(f"""WITH {O.BASE} SELECT (SELECT count(*) FROM proj) AS n_input, (SELECT count(*) FROM proj WHERE valid) AS n_valid,
(SELECT count(*) FROM proj WHERE valid AND depth > 0 AND u >= 0 AND u < 1280 AND v >= 0 AND v < 720) AS n_view, (SELECT count(*) FROM gated) AS n_height, (SELECT count(*) FROM owned) AS n_owned""")  # fmt: skip
def gate_funnel(spark, sf):
    p = R.projected(R.points(spark, sf))
    view = F.col("valid") & G.in_view("u", "v", "depth")
    c = p.agg(F.count(F.lit(1)).alias("n_input"), F.count_if("valid").alias("n_valid"), F.count_if(view).alias("n_view"), F.count_if(view & G.within("h", M.BROAD_HEIGHT)).alias("n_height"))
    return c.crossJoin(_owned(spark, sf).agg(F.count(F.lit(1)).alias("n_owned")))


@query(f"WITH {O.BASE} SELECT frame, pid, det FROM owned")
def point_ownership(spark, sf):
    return _owned(spark, sf).select("frame", "pid", "det")


@query(f"""WITH {O.BASE}, m AS (SELECT unnest([0e0, 0.05e0, 0.1e0, 0.25e0]) AS margin),
s AS (SELECT g.frame, g.pid, b.det, m.margin, greatest(x1 - u, 0e0, u - x2) / greatest(x2 - x1, 1e0) AS ox, greatest(y1 - v, 0e0, v - y2) / greatest(y2 - y1, 1e0) AS oy,
  sqrt(power((u - (x1 + x2) / 2) / greatest(x2 - x1, 1e0), 2) + power((v - (y1 + y2) / 2) / greatest(y2 - y1, 1e0), 2)) AS c FROM gated g JOIN boxes b ON g.frame = b.frame CROSS JOIN m),
r AS (SELECT *, row_number() OVER (PARTITION BY margin, frame, pid ORDER BY c + 2e0 * sqrt(ox * ox + oy * oy), det) AS rn FROM s WHERE ox <= margin AND oy <= 0.03e0)
SELECT margin, det, count(*) AS n_points, round(sum(c + 2e0 * sqrt(ox * ox + oy * oy)), 4) AS cost FROM r WHERE rn = 1 GROUP BY margin, det""")  # fmt: skip
def soft_ownership_margins(spark, sf):
    m = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.25,)], "margin double")
    o = joins.soft_owners(_gated(spark, sf), R.boxes(R.points(spark, sf)), m)
    return o.groupBy("margin", "det").agg(F.count(F.lit(1)).alias("n_points"), F.round(F.sum("own_cost"), 4).alias("cost"))


_VOXELS = "vox AS (SELECT CAST(floor(x / 0.5e0) AS INTEGER) AS kx, CAST(floor(y / 0.5e0) AS INTEGER) AS ky, CAST(floor(z / 0.5e0) AS INTEGER) AS kz, * FROM points), prior AS (SELECT kx, ky, kz, count(DISTINCT frame) AS n_frames FROM vox GROUP BY kx, ky, kz HAVING count(DISTINCT frame) >= greatest(3, ceil((SELECT count(DISTINCT frame) FROM points) * 0.12e0)))"


def _voxeled(spark, sf):
    return R.points(spark, sf).withColumns(dict(zip(("kx", "ky", "kz"), G.voxel("x", "y", "z", size=0.5), strict=True)))


def _prior(v, share=0.12):
    return A.frequent_voxels(v, "frame", ("kx", "ky", "kz"), share, 3)


@query(f"WITH {O.POINTS}, {_VOXELS} SELECT * FROM prior")
def voxel_frequency_prior(spark, sf):
    return _prior(_voxeled(spark, sf))


@query(f"WITH {O.POINTS}, {_VOXELS} SELECT frame, pid FROM vox WHERE (kx, ky, kz) NOT IN (SELECT (kx, ky, kz) FROM prior)")
def voxel_antijoin(spark, sf):
    v = _voxeled(spark, sf)
    return joins.voxel_antijoin(v, _prior(v)).select("frame", "pid")


_NEAR = "near AS (SELECT DISTINCT frame, pid FROM (SELECT p.frame, p.pid FROM points p JOIN occ o ON p.x BETWEEN o.ox - 0.08e0 AND o.ox + 0.08e0 AND power(p.x - o.ox, 2) + power(p.y - o.oy, 2) <= 0.07e0 * 0.07e0))"


@query(f"WITH {O.POINTS}, {O.OCC}, {_NEAR} SELECT frame, pid FROM near")
def occupancy_radius_semijoin(spark, sf):
    return joins.near_any(R.points(spark, sf), R.occupancy(spark, sf), M.OCCUPANCY_RADIUS_M).select("frame", "pid")


FLAGGED = f"""{O.BASE}, {O.OCC}, {_NEAR}, {_VOXELS},
flagged AS (SELECT g.frame, g.pid, g.z, g.h, n.pid IS NOT NULL AS near, p.kx IS NULL AS temporal_keep, w.pid IS NOT NULL AS person_owned FROM gated g
  LEFT JOIN near n ON g.frame = n.frame AND g.pid = n.pid LEFT JOIN owned w ON g.frame = w.frame AND g.pid = w.pid
  LEFT JOIN prior p ON p.kx = CAST(floor(g.x / 0.5e0) AS INTEGER) AND p.ky = CAST(floor(g.y / 0.5e0) AS INTEGER) AND p.kz = CAST(floor(g.z / 0.5e0) AS INTEGER))"""


def _near_and_prior(spark, sf, points, share=0.12):
    """Points with near and temporal_keep, each point where it is: neither flag moves or numbers the points anew."""
    p = points.withColumns(dict(zip(("kx", "ky", "kz"), G.voxel("x", "y", "z", size=0.5), strict=True)))
    p = joins.voxel_flag(p, joins.small(materialize(_prior(_voxeled(spark, sf), share), "prior")))
    return joins.near_flag(p, R.occupancy(spark, sf), M.OCCUPANCY_RADIUS_M).withColumn("temporal_keep", ~F.col("in_prior"))


def _flagged(spark, sf, share=0.12):
    own = _owned(spark, sf).select("frame", "pid", F.lit(True).alias("person_owned"))
    return _near_and_prior(spark, sf, _gated(spark, sf), share).join(own, ["frame", "pid"], "left").fillna(False, ["person_owned"])


@query(f"""WITH {FLAGGED}, p AS (SELECT unnest(['LEGACY', 'PHYSICAL_DIRECT', 'GROUND_LIMITED', 'HEIGHT_BANDED', 'TEMPORAL_PRIMARY_OCCUPANCY_SECONDARY', 'PERSON_CONDITIONAL_PROTECTION']) AS policy),
d AS (SELECT policy, temporal_keep, CASE policy WHEN 'LEGACY' THEN near AND (z - h <= 0.28e0 OR z - h >= 1.9e0) WHEN 'PHYSICAL_DIRECT' THEN near AND (h <= 0.28e0 OR h >= 1.9e0)
  WHEN 'TEMPORAL_PRIMARY_OCCUPANCY_SECONDARY' THEN near AND NOT temporal_keep AND h >= 0 AND h <= 0.28e0
  WHEN 'PERSON_CONDITIONAL_PROTECTION' THEN near AND (h <= 0.28e0 OR h >= 1.9e0) AND NOT (temporal_keep AND person_owned AND h BETWEEN 0.08e0 AND 2.15e0)
  ELSE near AND h >= 0 AND h <= 0.28e0 END AS removed FROM flagged CROSS JOIN p)
SELECT policy, count(*) AS n_points, count(*) FILTER (temporal_keep AND removed) AS occupancy_removed, count(*) FILTER (temporal_keep AND NOT removed) AS n_kept FROM d GROUP BY policy""")  # fmt: skip
def suppression_policies(spark, sf):
    """What each occupancy policy removes and keeps of the gated points."""
    p = spark.createDataFrame([(k,) for k in M.POLICIES], "policy string")
    d = _flagged(spark, sf).crossJoin(F.broadcast(p)).withColumn("keep", audit.occupancy_keep(F.col("policy"), "z", "h", "near", "temporal_keep", "person_owned"))
    return d.groupBy("policy").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("temporal_keep") & ~F.col("keep")).alias("occupancy_removed"), F.count_if(F.col("temporal_keep") & F.col("keep")).alias("n_kept"))


@query(f"""WITH {FLAGGED} SELECT k.name, count(*) FILTER (CASE k.name WHEN 'both' THEN temporal_keep AND NOT near WHEN 'temporal_only' THEN temporal_keep WHEN 'occupancy_only' THEN NOT near ELSE true END) AS n_kept
FROM flagged CROSS JOIN (SELECT unnest(['both', 'temporal_only', 'occupancy_only', 'none']) AS name) k GROUP BY k.name""")  # fmt: skip
def suppression_ablation(spark, sf):
    t, o = F.col("temporal_keep"), ~F.col("near")
    c = _flagged(spark, sf).agg(F.count_if(t & o).alias("both"), F.count_if(t).alias("temporal_only"), F.count_if(o).alias("occupancy_only"), F.count(F.lit(1)).alias("none"))
    return c.unpivot([], ["both", "temporal_only", "occupancy_only", "none"], "name", "n_kept")


_EDGES = "edges AS (SELECT a.frame, a.det, a.pid AS i, b.pid AS j FROM owned a JOIN owned b ON a.frame = b.frame AND a.det = b.det AND a.pid < b.pid AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= 0.18e0 + 0.02e0 * sqrt(a.x * a.x + a.y * a.y))"
_LABELS = f"""WITH RECURSIVE {O.BASE}, {_EDGES}, both_ways AS (SELECT frame, det, i, j FROM edges UNION ALL SELECT frame, det, j, i FROM edges),
reach AS (SELECT frame, det, pid, pid AS low FROM owned UNION SELECT r.frame, r.det, e.j, r.low FROM reach r JOIN both_ways e ON r.frame = e.frame AND r.det = e.det AND r.pid = e.i WHERE r.low < e.j),
labels AS (SELECT frame, det, pid, min(low) AS label FROM reach GROUP BY frame, det, pid)"""


@query(f"WITH {O.BASE}, {_EDGES} SELECT * FROM edges")
def adaptive_edges(spark, sf):
    return joins.adaptive_edges(_owned(spark, sf))


@query(f"{_LABELS} SELECT frame, det, pid, label FROM labels")
def connected_components(spark, sf):
    return cluster.label_components(_owned(spark, sf)).select("frame", "det", "pid", "label")


_SCORED = f"""{_LABELS}, comps AS (SELECT o.frame, o.det, label, count(*) AS n, (quantile_cont(x, 0.05) + quantile_cont(x, 0.95)) / 2 AS cx, (quantile_cont(y, 0.05) + quantile_cont(y, 0.95)) / 2 AS cy,
  (quantile_cont(z, 0.05) + quantile_cont(z, 0.95)) / 2 AS cz, greatest(max(x) - min(x), max(y) - min(y)) AS hspan, max(z) - min(z) AS vspan, any_value(x1) AS x1, any_value(y1) AS y1, any_value(x2) AS x2, any_value(y2) AS y2
  FROM owned o JOIN labels l ON o.frame = l.frame AND o.det = l.det AND o.pid = l.pid GROUP BY o.frame, o.det, label HAVING count(*) >= 3),
{_center_projection('comps').replace('camera AS', 'camera2 AS').replace('FROM camera)', 'FROM camera2)').replace('rays AS', 'rays2 AS').replace('FROM rays)', 'FROM rays2)').replace('radial AS', 'radial2 AS').replace('FROM radial)', 'FROM radial2)').replace('proj AS', 'proj2 AS')},
scored AS (SELECT frame, det, label, n, {_SCORE} AS score FROM proj2 WHERE valid),
ranked AS (SELECT *, row_number() OVER w AS rnk, lead(score) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY frame, det ORDER BY round(score, 9), n DESC, label))"""


def _scored(spark, sf):
    c = cluster.found_components(_owned(spark, sf)).join(R.boxes(R.points(spark, sf)), ["frame", "det"])
    return G.with_projection(c, "cx", "cy", "cz", shift="inference").withColumn("score", F.round(B.component_score("u", "v", B.box(""), "hspan", "vspan", "n"), 9))


@query(f"{_SCORED} SELECT frame, det, label, n, round(score, 4) AS score FROM ranked WHERE rnk = 1")
def component_choice(spark, sf):
    return windows.ranked_components(_scored(spark, sf)).where("rnk = 1").select("frame", "det", "label", "n", F.round("score", 4).alias("score"))


@query(f"{_SCORED} SELECT frame, det, round(nxt - score, 4) AS margin, coalesce(nxt - score < 0.05e0, false) AS ambiguous FROM ranked WHERE rnk = 1")
def second_best_margin(spark, sf):
    return windows.ranked_components(_scored(spark, sf)).where("rnk = 1").select("frame", "det", F.round("margin", 4).alias("margin"), "ambiguous")


@query(f"WITH {O.BASE} SELECT g.frame, g.pid, count(b.det) AS n_boxes FROM gated g LEFT JOIN boxes b ON g.frame = b.frame AND u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2 GROUP BY g.frame, g.pid")
def containment_count(spark, sf):
    return joins.containing(_gated(spark, sf), R.boxes(R.points(spark, sf)), row="pid").select("frame", "pid", "n_boxes")


@query(f"""WITH {O.BASE}, d AS (SELECT a.frame, a.pid, b.pid AS neighbour, sqrt(power(a.u - b.u, 2) + power(a.v - b.v, 2)) AS distance FROM gated a JOIN gated b ON a.frame = b.frame AND a.pid <> b.pid),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, pid ORDER BY distance, neighbour) AS rank FROM d WHERE distance <= 14e0) SELECT frame, pid, neighbour, round(distance, 4) AS distance, rank FROM r WHERE rank <= 9""")  # fmt: skip
def knn_pixels(spark, sf):
    return joins.nearest_k(_gated(spark, sf), ["frame"], "pid", 9, 14.0).select("frame", "pid", "neighbour", F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {O.POINTS}, s AS (SELECT frame, pid, sqrt(x * x + y * y + z * z) AS range, degrees(atan2(y, x)) AS azimuth, degrees(atan2(z, sqrt(x * x + y * y))) AS elevation FROM points),
k AS (SELECT *, CAST(greatest(0, least(15, ceil((elevation + 15e0) / 2e0 - 0.5e0))) AS INTEGER) AS ring FROM s WHERE range BETWEEN 1 AND 18),
m AS (SELECT *, count(*) OVER (PARTITION BY frame, ring) AS c FROM k WHERE abs(elevation - (ring * 2 - 15)) < 0.75e0),
e AS (SELECT *, lag(azimuth) OVER w AS pa, lag(range) OVER w AS pr, lead(azimuth) OVER w AS na, lead(range) OVER w AS nr FROM m WHERE c >= 4 WINDOW w AS (PARTITION BY frame, ring ORDER BY azimuth, pid))
SELECT frame, pid, ring FROM e WHERE (abs(pa - azimuth) > 0.01e0 AND abs(pa - azimuth) < 0.45e0 AND abs(pr - range) > greatest(0.25e0, least(pr, range) * 0.045e0))
  OR (abs(na - azimuth) > 0.01e0 AND abs(na - azimuth) < 0.45e0 AND abs(nr - range) > greatest(0.25e0, least(nr, range) * 0.045e0))""")  # fmt: skip
def ring_edges(spark, sf):
    return windows.ring_edges(R.points(spark, sf)).select("frame", "pid", "ring")


@query(f"""WITH {O.BASE}, s AS (SELECT *, sqrt(x * x + y * y + z * z) AS range, degrees(atan2(y, x)) AS azimuth, degrees(atan2(z, sqrt(x * x + y * y))) AS elevation FROM proj),
k AS (SELECT *, CAST(greatest(0, least(15, ceil((elevation + 15e0) / 2e0 - 0.5e0))) AS INTEGER) AS ring FROM s WHERE range BETWEEN 1 AND 18),
m AS (SELECT *, count(*) OVER (PARTITION BY frame, ring) AS c FROM k WHERE abs(elevation - (ring * 2 - 15)) < 0.75e0),
e AS (SELECT *, lag(azimuth) OVER w AS pa, lag(range) OVER w AS pr, lead(azimuth) OVER w AS na, lead(range) OVER w AS nr FROM m WHERE c >= 4 WINDOW w AS (PARTITION BY frame, ring ORDER BY azimuth, pid)),
edge AS (SELECT frame, pid AS edge, u, v FROM e WHERE valid AND ((abs(pa - azimuth) > 0.01e0 AND abs(pa - azimuth) < 0.45e0 AND abs(pr - range) > greatest(0.25e0, least(pr, range) * 0.045e0))
  OR (abs(na - azimuth) > 0.01e0 AND abs(na - azimuth) < 0.45e0 AND abs(nr - range) > greatest(0.25e0, least(nr, range) * 0.045e0)))),
r AS (SELECT g.frame, g.pid, edge, sqrt(power(g.u - edge.u, 2) + power(g.v - edge.v, 2)) AS distance, row_number() OVER (PARTITION BY g.frame, g.pid ORDER BY sqrt(power(g.u - edge.u, 2) + power(g.v - edge.v, 2)), edge) AS rank FROM gated g JOIN edge ON g.frame = edge.frame)
SELECT frame, pid, edge, round(distance, 4) AS distance, rank FROM r WHERE rank <= 2""")  # fmt: skip
def nearest_edges(spark, sf):
    """The two depth edges of a scan that are nearest to each point's pixel, however far."""
    edges = R.projected(windows.ring_edges(R.points(spark, sf))).where("valid").select("frame", F.col("pid").alias("edge"), "u", "v")
    return joins.nearest_of(_gated(spark, sf), edges, ["frame"], "pid", "edge", 2, 16.0).select("frame", "pid", "edge", F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {O.BASE}, p AS (SELECT a.frame, a.det, b.det AS other, greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS both_,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.det < b.det)
SELECT frame, det, other, round(both_ / greatest(sa + sb - both_, 1e-9), 6) AS iou, round(both_ / greatest(least(sa, sb), 1e-9), 6) AS over_smaller FROM p""")  # fmt: skip
def box_overlaps(spark, sf):
    b = R.boxes(R.points(spark, sf))
    o = b.select("frame", F.col("det").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    p = b.join(o, "frame").where("det < other")
    return p.select("frame", "det", "other", r6(B.iou(B.box(""), B.box("o_")), "iou"), r6(B.over_smaller(B.box(""), B.box("o_")), "over_smaller"))


@query(f"""WITH {O.BASE}, t AS (SELECT *, (x1 + x2) / 2 AS cu, u AS pu FROM owned)
SELECT frame, pid, det, round(cu - pu, 4) AS residual FROM t WHERE conf >= 0.5e0 AND abs(cu - pu) <= greatest(100e0, 0.75e0 * (x2 - x1)) AND cu - pu BETWEEN -80 AND 120""")  # fmt: skip
def calibration_residuals(spark, sf):
    r = _owned(spark, sf).withColumn("residual", G.calibration_residual("u", "x1", "x2", "conf", F.lit(3), "depth"))
    return r.where("residual is not null").select("frame", "pid", "det", F.round("residual", 4).alias("residual"))


@query(f"""WITH {O.BASE} SELECT frame, pid, CASE WHEN v < 240 THEN 'top' WHEN v < 480 THEN 'middle' ELSE 'bottom' END || '_' || CASE WHEN u < 1280 / 3e0 THEN 'left' WHEN u < 2560 / 3e0 THEN 'center' ELSE 'right' END AS region,
CASE WHEN depth < 3 THEN '0-3m' WHEN depth < 6 THEN '3-6m' WHEN depth < 9 THEN '6-9m' ELSE '>9m' END AS depth_bin FROM gated""")  # fmt: skip
def depth_region_size_bins(spark, sf):
    return _gated(spark, sf).select("frame", "pid", B.region("u", "v").alias("region"), B.depth_bin("depth").alias("depth_bin"))
