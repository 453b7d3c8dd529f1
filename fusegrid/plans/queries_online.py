"""The online path over the sensor relations: measured scans, their counters, and what images report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.functions import boxes as B
from fusegrid.functions import geometry as G
from fusegrid.functions import model as M
from fusegrid.operators import aggregates as A
from fusegrid.operators import audit, cluster, joins, residuals, windows
from fusegrid.operators.residuals import CONFIG as AUDIT
from fusegrid.plans import queries_geometry as Q
from fusegrid.plans.registry import r6, registry
from fusegrid.plans.scratch import materialize
from fusegrid.sources import oracle as O
from fusegrid.sources import relations as R
from fusegrid.streaming import online

QUERIES, ORACLES, query = registry()
n = O.n
SCENE, PERIOD_NS = 50, 100_000_000
#: The share of frames in which a voxel of the temporal prior is seen; a lower one would leave next to nothing of these points.
PRIOR_SHARE = 0.35
CORNERS = ("x1", "y1", "x2", "y2")
_LOW, _HIGH = M.CLASS_HEIGHT["PERSON"]


def _best(points: DataFrame, boxes: DataFrame, keys: tuple = ("frame",)) -> DataFrame:
    """(keys, det) with the best component of the points that each box owns, of a person's height: centre, n, score, spans, pixel, ambiguous."""
    return _best_owned(_person_points(joins.owners(points, boxes, keys)), boxes, keys)


def _person_points(owned: DataFrame) -> DataFrame:
    return owned.where(G.within("h", M.CLASS_HEIGHT["PERSON"]))


def _best_owned(owned: DataFrame, boxes: DataFrame, keys: tuple) -> DataFrame:
    """``_best`` of points with their owner ``det``."""
    box = [*keys, "det"]
    c = cluster.found_components(owned, box).join(boxes, box)
    s = G.with_projection(c, "cx", "cy", "cz", shift="inference").withColumn("score", F.round(B.component_score("u", "v", B.box(""), "hspan", "vspan", "n"), 9))
    return s.join(windows.ranked_components(s, box).where("rnk = 1").select(*box, "label", "ambiguous"), [*box, "label"])


def _flagged(spark, sf) -> DataFrame:
    """Gated points with the keeps of both priors, written once for all that reads them; this policy does not ask who owns a point."""
    flagged = Q._near_and_prior(spark, sf, Q._gated(spark, sf), PRIOR_SHARE).withColumn("person_owned", F.lit(False))
    return materialize(_kept(flagged, F.lit("LEGACY")), "online-flagged")


def _kept(flagged: DataFrame, policy, *more: str) -> DataFrame:
    keep = audit.occupancy_keep(policy, "z", "h", "near", "temporal_keep", "person_owned")
    return flagged.withColumn("occupancy_keep", keep).select(*more, "frame", "pid", "x", "y", "z", "h", "u", "v", "depth", "temporal_keep", "occupancy_keep")


def _measured(flagged: DataFrame, boxes: DataFrame) -> DataFrame:
    return _best(flagged.where("temporal_keep and occupancy_keep"), boxes)


GEOMETRIC = ("points_input", "points_projection_valid", "points_in_view", "points_height_candidate", "temporal_removed", "occupancy_removed", "points_after_static", "detections", "components_available", "measurements")


def _counters(spark, sf, flagged: DataFrame, boxes: DataFrame, measured: DataFrame) -> DataFrame:
    p = R.projected(R.points(spark, sf))
    view = F.col("valid") & G.in_view("u", "v", "depth")
    seen = p.groupBy("frame").agg(F.count(F.lit(1)).alias("points_input"), F.count_if("valid").alias("points_projection_valid"), F.count_if(view).alias("points_in_view"), F.count_if(view & G.within("h", M.BROAD_HEIGHT)).alias("points_height_candidate"))
    t, o = F.col("temporal_keep"), F.col("occupancy_keep")
    static = flagged.groupBy("frame").agg(F.count_if(~t).alias("temporal_removed"), F.count_if(t & ~o).alias("occupancy_removed"), F.count_if(t & o).alias("points_after_static"))
    detected = boxes.groupBy("frame").agg(F.count(F.lit(1)).alias("detections"))
    # a component whose centre has no pixel is available and not chosen; those of the range here all have one
    found = measured.groupBy("frame").agg(F.count(F.lit(1)).alias("components_available"), F.count("score").alias("measurements"))
    out = seen
    for part in (static, detected, found):
        out = out.join(part, "frame", "left")
    return out.fillna(0).select("frame", *GEOMETRIC)


_USABLE = f"""{O.OCC}, {Q._NEAR}, {Q._VOXELS.replace("0.12e0", n(PRIOR_SHARE))}, kept AS (SELECT g.*, p.kx IS NULL AS temporal, NOT (n.pid IS NOT NULL AND (g.z - g.h <= 0.28e0 OR g.z - g.h >= 1.9e0)) AS clear FROM gated g LEFT JOIN near n ON g.frame = n.frame AND g.pid = n.pid
  LEFT JOIN prior p ON p.kx = CAST(floor(g.x / 0.5e0) AS INTEGER) AND p.ky = CAST(floor(g.y / 0.5e0) AS INTEGER) AND p.kz = CAST(floor(g.z / 0.5e0) AS INTEGER)),
usable AS (SELECT * EXCLUDE (temporal, clear) FROM kept WHERE temporal AND clear),
{O.OWNED.replace("FROM gated g", "FROM usable g").replace("WHERE rn = 1", f"WHERE rn = 1 AND h BETWEEN {_LOW} AND {_HIGH}")}"""
_ONLINE = Q._SCORED.replace(O.OWNED, _USABLE)


@query(f"""{_ONLINE}, a AS (SELECT frame, count(*) AS points_input, count(*) FILTER (valid) AS points_projection_valid, count(*) FILTER (valid AND depth > 0 AND u >= 0 AND u < 1280 AND v >= 0 AND v < 720) AS points_in_view FROM proj GROUP BY frame),
b AS (SELECT frame, count(*) AS points_height_candidate, count(*) FILTER (NOT temporal) AS temporal_removed, count(*) FILTER (temporal AND NOT clear) AS occupancy_removed, count(*) FILTER (temporal AND clear) AS points_after_static FROM kept GROUP BY frame),
c AS (SELECT frame, count(*) AS detections FROM boxes GROUP BY frame), d AS (SELECT frame, count(DISTINCT det) AS components_available, count(*) FILTER (rnk = 1) AS measurements FROM ranked GROUP BY frame)
SELECT a.frame, points_input, points_projection_valid, points_in_view, {", ".join(f"coalesce({x}, 0) AS {x}" for x in GEOMETRIC[3:])} FROM a LEFT JOIN b ON a.frame = b.frame LEFT JOIN c ON a.frame = c.frame LEFT JOIN d ON a.frame = d.frame""")  # fmt: skip
def scan_counters(spark, sf):
    """What each stage of a scan's measurement leaves: points, detections, components, measurements."""
    flagged, boxes = _flagged(spark, sf), R.boxes(R.points(spark, sf))
    return _counters(spark, sf, flagged, boxes, _measured(flagged, boxes))


def _images(rows: DataFrame) -> DataFrame:
    """Two images after each scan, with the scan's boxes a little moved."""
    at = F.explode(F.array(F.lit(33_000_000), F.lit(66_000_000))).alias("after")
    d = rows.select("scene", "ns", "det", "cls", "conf", *CORNERS, at)
    return d.select("scene", (F.col("ns") + F.col("after")).alias("ns"), F.lit(online.IMAGE).alias("kind"), "det", "cls", "conf", *[(F.col(c) + F.col("after") / 33_000_000).alias(c) for c in CORNERS])


def sightings(*parts: DataFrame) -> DataFrame:
    """The union of scans and images with all columns of ``online.SIGHTING``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    types = dict(c.split() for c in online.SIGHTING.split(", "))
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _scans(boxes: DataFrame, measured: DataFrame, best: DataFrame, keys: tuple = ("frame",)) -> DataFrame:
    """Scans with measured positions, with candidates, the ``best`` of what occupancy removed, beside them."""
    box = [*keys, "det"]
    # a candidate competes if another person's box holds its pixel
    other = boxes.select(*keys, F.col("det").alias("other"), *[F.col(c).alias(f"o{c}") for c in CORNERS])
    rivals = best.join(other, list(keys)).where("other <> det").where(B.inside("u", "v", B.box("o"))).select(*box).distinct().withColumn("rival", F.lit(True))
    candidate = best.join(rivals, box, "left").select(
        *box, F.col("n").cast("double").alias("rn"), F.col("cx").alias("rx"), F.col("cy").alias("ry"), F.col("cz").alias("rz"), F.col("score").alias("rscore"),
        B.inside("u", "v", B.box("")).alias("rinside"), B.plausible("hspan", "vspan").alias("rplausible"), F.coalesce("rival", F.lit(False)).alias("rcompetition"), F.col("ambiguous").alias("rambiguous"),
    )
    place = measured.select(*box, F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    rows = boxes.join(place, box, "left").join(candidate, box, "left")
    return rows.withColumns({"scene": F.floor(F.col("frame") / SCENE), "ns": (F.col("frame") % SCENE + 1) * PERIOD_NS, "kind": F.lit(online.SCAN)})


def measured_sightings(spark, sf, flagged: DataFrame | None = None, boxes: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """Measured scans, and images between them."""
    flagged = _flagged(spark, sf) if flagged is None else flagged
    boxes = R.boxes(R.points(spark, sf)) if boxes is None else boxes
    removed = _best(flagged.where("temporal_keep and not occupancy_keep"), boxes)
    rows = _scans(boxes, _measured(flagged, boxes) if measured is None else measured, removed)
    return sightings(rows.drop("frame"), _images(rows))


STATEFUL = ("person_measurements", "robot_measurements", "recovery_attempts", "recovery_accepted", "recovery_rejected")


@query()
def online_scan_counters(spark, sf):
    """All fifteen counters of each scan: those of the geometry, and those of tracking and recovery."""
    flagged, boxes = _flagged(spark, sf), R.boxes(R.points(spark, sf))
    measured = materialize(_measured(flagged, boxes), "online-measured")
    path = online.batch(measured_sightings(spark, sf, flagged, boxes, measured), recover=True).where(F.col("kind") == online.SCAN).where("det = -1")
    frame = F.col("scene") * SCENE + (F.col("ns") / PERIOD_NS).cast("long") - 1
    state = path.select(frame.alias("frame"), F.col("measurements").alias("measurements_recovered"), *STATEFUL)
    return _counters(spark, sf, flagged, boxes, measured).join(state, "frame").select("frame", *GEOMETRIC[:-1], F.col("measurements_recovered").cast("long").alias("measurements"), *[F.col(c).cast("long").alias(c) for c in STATEFUL])


@query()
def online_path(spark, sf):
    """What images report of the measured scans' motions."""
    return online.batch(measured_sightings(spark, sf), recover=True).where(F.col("kind") == online.IMAGE)


#: Policies that must agree row by row, with and without recovery.
MIRRORED = [(f"GROUND_LIMITED{h}", f"HEIGHT_BANDED{h}") for h in ("", "_HISTORY")]
VARIANTS = {p: [p, f"{p}_HISTORY"] for p in M.POLICIES}


def variant_rows(spark, sf) -> DataFrame:
    """The scans under every policy, with and without recovery: one table of flagged points, fanned out to the policies' states.

    A point's owner is the same under every policy, so it is found once, and only owned points are fanned out.
    Each policy's points are keyed by (policy, frame), so all policies go through one plan; what a policy keeps and what
    it removes are labelled together, side by side.
    """
    boxes, keys = R.boxes(R.points(spark, sf)), ("policy", "frame")
    flagged = Q._near_and_prior(spark, sf, Q._gated(spark, sf), PRIOR_SHARE).where("temporal_keep")
    owned = materialize(_person_points(joins.owners(flagged, boxes)).select(*flagged.columns, "det", F.lit(True).alias("person_owned")), "variant-owned")
    policy = F.explode(F.array(*[F.lit(p) for p in M.POLICIES])).alias("policy")
    points, boxes = _kept(owned.select("*", policy), F.col("policy"), "policy", "det"), boxes.select("*", policy)
    side = F.explode(F.array(F.lit(True), F.lit(False))).alias("occupancy_keep")
    best = materialize(_best_owned(points, boxes.select("*", side), ("occupancy_keep", *keys)), "variant-best")
    rows = _scans(boxes, best.where("occupancy_keep").drop("occupancy_keep"), best.where("not occupancy_keep").drop("occupancy_keep"), keys).withColumn("variant", F.col("policy"))
    shared = materialize(sightings(rows.drop("frame", "policy")), "variant-scans")
    return online.batch(online.fan_out(shared, VARIANTS), {v: {"recover": v.endswith("_HISTORY")} for vs in VARIANTS.values() for v in vs}, prototypes={})


@query()
def online_variant_counters(spark, sf):
    """Boxes, components and recoveries of each variant in each split."""
    rows = variant_rows(spark, sf).withColumn("frame", F.col("scene") * SCENE + (F.col("ns") / PERIOD_NS).cast("long") - 1)
    last = R.points(spark, sf).agg((F.max("frame") + 1).alias("frames"))
    d = rows.crossJoin(F.broadcast(last)).withColumn("split", audit.split_of(F.col("frame"), F.col("frames")))
    of = lambda s: F.count_if((F.col("det") >= 0) & (F.col("measurement_source") == s))
    return d.groupBy("split", "variant").agg(
        F.count_if(F.col("det") >= 0).alias("person_boxes"), of("NORMAL_COMPONENT").alias("normal_components"), of("UNAVAILABLE").alias("unavailable"),
        F.sum("recovery_attempts").alias("history_attempts"), F.sum("recovery_accepted").alias("history_recovered"),
    )


@query()
def online_variant_mirrors(spark, sf):
    """How many rows differ between variants that must agree."""
    return online.mirrors(variant_rows(spark, sf), MIRRORED)


def single_person(spark, sf) -> DataFrame:
    """Scenes of one person who walks and is lost now and then, and images with that person's box and another one."""
    p = R.points(spark, sf).groupBy("frame").agg(*[A.exact_mean(c).alias(f"m{c}") for c in "xyz"])
    frame, place = F.col("frame"), F.col("frame") % SCENE
    p = p.withColumns({"scene": F.floor(frame / SCENE), "ns": (place + 1) * PERIOD_NS, "cls": F.lit("PERSON"), "conf": F.lit(0.9)})
    p = G.with_projection(p.withColumns({"px": place % 7 / 10 + 2 + F.col("mx") / 100, "py": F.col("my") / 100, "pz": F.col("mz")}), "px", "py", "pz", shift="inference")
    lost = (frame % 6 == 0) | (frame % 13 < 3)
    scan = p.select("scene", "ns", F.lit(online.SCAN).alias("kind"), F.lit(0).alias("det"), "cls", "conf", *[F.lit(v).alias(c) for c, v in zip(CORNERS, (100.0, 100.0, 200.0, 300.0), strict=True)], *[F.when(~lost, F.col(f"p{c}")).alias(c) for c in "xyz"])
    left = F.col("u") - 50 + frame % 5 * 30
    one = F.array(left, F.col("v") - 80, left + 100, F.col("v") + 80)
    decoy = [(frame * 97 % 1000).cast("double"), (frame * 53 % 400).cast("double")]
    two = F.array(*decoy, decoy[0] + 100, decoy[1] + 200)
    boxes = p.select("scene", "ns", "cls", "conf", F.posexplode(F.array(one, two)).alias("det", "b"))
    image = _images(boxes.select("*", *[F.col("b")[i].alias(c) for i, c in enumerate(CORNERS)]))
    return sightings(scan, image)


#: Scans until the audit of a scene here, and how many of them need samples.
WARMUP, SAMPLED = 10, 5


def _bins(x: str, at: tuple[float, float], name: str) -> str:
    return f"{name} AS (SELECT scene, count(*) AS g, max(med) - min(med) AS spread FROM (SELECT scene, CASE WHEN {x} < {n(at[0])} THEN 0 WHEN {x} < {n(at[1])} THEN 1 ELSE 2 END AS b, median(residual) AS med FROM fit GROUP BY 1, 2 HAVING count(*) >= {AUDIT['bin_samples']}) GROUP BY scene)"


@query(f"""WITH {O.BASE}, scans AS (SELECT frame, frame // {SCENE} AS scene, row_number() OVER (PARTITION BY frame // {SCENE} ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY frame // {SCENE}) AS scans FROM (SELECT DISTINCT frame FROM points)),
s AS (SELECT scene, o.frame, i, (x1 + x2) / 2 - u AS residual, depth, u FROM owned o JOIN scans ON o.frame = scans.frame WHERE scans >= {WARMUP} AND i < {WARMUP} AND conf >= 0.5e0 AND depth > 0 AND abs((x1 + x2) / 2 - u) <= greatest(100e0, 0.75e0 * (x2 - x1)) AND (x1 + x2) / 2 - u BETWEEN -80 AND 120),
fit AS (SELECT * FROM s WHERE i < {int(AUDIT["fit_fraction"] * WARMUP)}), f AS (SELECT scene, i, median(residual) AS med FROM fit GROUP BY scene, i), bl AS (SELECT scene, b, median(med) AS med FROM (SELECT *, ntile(4) OVER (PARTITION BY scene ORDER BY i) AS b FROM f) GROUP BY scene, b),
block AS (SELECT scene, count(*) AS g, max(med) - min(med) AS spread FROM bl GROUP BY scene), {_bins("depth", AUDIT["depths"], "deep")}, {_bins("u", AUDIT["columns"], "region")},
o AS (SELECT scene, count(DISTINCT frame) AS dynamic_frames, coalesce(median(residual) FILTER (i < {int(AUDIT["fit_fraction"] * WARMUP)}), 0e0) AS du FROM s GROUP BY scene), c AS (SELECT *, least(greatest(round_even(du / 2e0, 0) * 2e0, -80e0), 120e0) AS candidate FROM o),
h AS (SELECT s.scene, median(abs(residual)) AS hb, median(abs(residual - candidate)) AS hc FROM s JOIN c ON s.scene = c.scene WHERE i >= {int(AUDIT["fit_fraction"] * WARMUP)} GROUP BY s.scene),
a AS (SELECT t.scene, t.scans, t.scans >= {WARMUP} AS done, coalesce(dynamic_frames, 0) AS dynamic_frames, du, candidate, block.spread AS bs, deep.spread AS ds, region.spread AS rs, hb, hc, coalesce(1 - hc / greatest(hb, 1e-6), 0e0) AS improvement,
  coalesce(dynamic_frames >= {SAMPLED}, false) AS k1, coalesce(block.spread <= 12, false) AS k2, coalesce(deep.g >= 2 AND deep.spread <= 12, false) AS k3, coalesce(region.g >= 2 AND region.spread <= 12, false) AS k4 FROM (SELECT DISTINCT scene, scans FROM scans) t LEFT JOIN c ON c.scene = t.scene LEFT JOIN h ON h.scene = t.scene
  LEFT JOIN block ON block.scene = t.scene LEFT JOIN deep ON deep.scene = t.scene LEFT JOIN region ON region.scene = t.scene)
SELECT scene, CASE WHEN NOT done THEN 'WARMUP' WHEN k1 AND k2 AND k3 AND k4 AND improvement >= 0.05e0 THEN 'PASS' ELSE 'FAIL' END AS state, scans, CASE WHEN done THEN dynamic_frames END AS dynamic_frames,
  {", ".join(f"round(CASE WHEN done THEN {x} END, 6) AS {name}" for name, x in (("dynamic_du", "du"), ("candidate", "candidate"), ("block_spread", "bs"), ("depth_spread", "ds"), ("region_spread", "rs"), ("hold_baseline", "hb"), ("hold_candidate", "hc"), ("improvement", "improvement")))},
  {", ".join(f"CASE WHEN done THEN {x} END AS {name}" for name, x in zip(residuals.CHECKS, ("k1", "k2", "k3", "k4", "improvement >= 0.05e0"), strict=True))} FROM a""")  # fmt: skip
def residual_audit(spark, sf):
    """The audit of each scene's first scans, over the column residuals of owned points."""
    points, scene = R.points(spark, sf), F.floor(F.col("frame") / SCENE).alias("scene")
    s = Q._owned(spark, sf).withColumn("residual", G.calibration_residual("u", "x1", "x2", "conf", F.lit(3), "depth")).where("residual is not null")
    out = residuals.residual_audit(s.select(scene, "frame", "residual", "depth", "u"), points.select(scene, "frame"), WARMUP, AUDIT | {"dynamic_frames": SAMPLED})
    return out.select(*[r6(c) if t == "double" else c for c, t in out.dtypes])


_WALK = f"""{O.POINTS}, m AS (SELECT frame, {", ".join(f"CAST(sum(CAST({c} AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS m{c}" for c in "xyz")} FROM points GROUP BY frame),
w AS (SELECT frame, frame // {SCENE} AS scene, (frame % {SCENE} + 1) * {PERIOD_NS} AS ns, frame % {SCENE} % 7 / 1e1 + 2 + mx / 1e2 AS x, my / 1e2 AS y, mz AS z, NOT (frame % 6 = 0 OR frame % 13 < 3) AS ok FROM m)"""


def _projected(name: str, source: str) -> str:
    """CTEs that project the points of ``source`` into ``name``, keeping its other columns."""
    sql = O.projected().replace("FROM points", f"FROM {source}").replace("SELECT frame, pid, x, y, z, valid,", "SELECT * EXCLUDE (cx, cy, cz, a, b, r2),")
    for c in ("camera", "rays", "radial", "proj"):
        sql = sql.replace(f"{c} AS (", f"{c}_{name} AS (").replace(f"FROM {c})", f"FROM {c}_{name})")
    return sql


def _cost(i: int) -> str:
    w, h = f"greatest(b{i}[3] - b{i}[1], 1e0)", f"greatest(b{i}[4] - b{i}[2], 1e0)"
    out = f"sqrt(power(greatest(b{i}[1] - u, 0e0, u - b{i}[3]) / {w}, 2) + power(greatest(b{i}[2] - v, 0e0, v - b{i}[4]) / {h}, 2))"
    return f"0.7e0 * {out} + 0.3e0 * sqrt(power((u - (b{i}[1] + b{i}[3]) / 2) / {w}, 2) + power((v - (b{i}[2] + b{i}[4]) / 2) / {h}, 2))"


@query(f"""WITH RECURSIVE {_WALK}, s AS (SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY ns) AS k, ns, x, y, z FROM w WHERE ok),
r AS (SELECT scene, k, ns, x, y, z, 0e0 AS vx, 0e0 AS vy FROM s WHERE k = 1
  UNION ALL SELECT s.scene, s.k, s.ns, s.x, s.y, s.z, 0.72e0 * r.vx + 0.28e0 * (s.x - r.x) / ((s.ns - r.ns) / 1e9), 0.72e0 * r.vy + 0.28e0 * (s.y - r.y) / ((s.ns - r.ns) / 1e9) FROM r JOIN s ON s.scene = r.scene AND s.k = r.k + 1),
{_projected("walk", "w")}, i AS (SELECT scene, ns + after AS ns, list_transform([u - 50 + frame % 5 * 30, v - 80, u + 50 + frame % 5 * 30, v + 80], lambda c: c + after / 33e6) AS b0,
  list_transform([frame * 97 % 1000, frame * 53 % 400, frame * 97 % 1000 + 100, frame * 53 % 400 + 200], lambda c: c + after / 33e6) AS b1 FROM proj_walk CROSS JOIN (SELECT unnest([33000000, 66000000]) AS after)),
j AS (SELECT i.scene, i.ns, b0, b1, r.k, (i.ns - r.ns) / 1e6 AS horizon_ms, r.x + r.vx * ((i.ns - r.ns) / 1e9) AS x, r.y + r.vy * ((i.ns - r.ns) / 1e9) AS y, r.z AS z, r.vx, r.vy FROM i ASOF JOIN r ON i.scene = r.scene AND i.ns >= r.ns),
{_projected("ahead", "(SELECT * FROM j WHERE horizon_ms <= 180)")}, c AS (SELECT *, {_cost(0)} AS c0, {_cost(1)} AS c1 FROM proj_ahead),
hit AS (SELECT *, CASE WHEN c0 <= c1 THEN 0 ELSE 1 END AS det, row_number() OVER (PARTITION BY scene, k ORDER BY ns) AS nth FROM c WHERE least(c0, c1) <= 1.15e0)
SELECT scene, CAST(ns AS BIGINT) AS ns, CAST(det AS INTEGER) AS det, 'T0001' AS track_id, {", ".join(f"round({c}, 9) AS {c}" for c in ("x", "y", "z", "vx", "vy", "horizon_ms"))}, CASE WHEN nth = 1 THEN 'LIDAR_MEASUREMENT' ELSE 'CAUSAL_PREDICTION' END AS state_source FROM hit""")  # fmt: skip
def online_association(spark, sf):
    """One track a scene: the projected motion of each image against its boxes, and the first report of each measurement."""
    rows = online.batch(single_person(spark, sf)).where(F.col("kind") == online.IMAGE)
    return rows.select("scene", "ns", "det", "track_id", *[F.round(c, 9).alias(c) for c in ("x", "y", "z", "vx", "vy", "horizon_ms")], "state_source")
