"""Queries over keyed state.  Where SQL cannot express them, tests hold them against brute force and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusegrid.operators import aggregates as A
from fusegrid.plans.registry import registry
from fusegrid.sources import oracle as O
from fusegrid.sources import relations as R
from fusegrid.streaming import folds, thresholds

QUERIES, ORACLES, query = registry()
KNOWN = {"G01": [1.0, 0.0], "G02": [0.0, 1.0]}


def _scenes(spark, sf):
    """Detections in scenes of fifty frames: each third of a frame's points makes one, at its mean."""
    p = R.points(spark, sf).groupBy("frame", (F.pmod("pid", F.lit(3)) + 1).cast("int").alias("det")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    d, place = F.col("det"), F.col("frame") % 50
    x1, y1 = F.pmod(d * 300 + F.col("frame") * 3, F.lit(1000)).cast("double"), d.cast("double") * 20
    x = d * 2 + F.pmod("frame", F.lit(7)) / 10 + F.col("x") / 100
    return p.select(F.floor(F.col("frame") / 50).alias("scene"), place.alias("frame"), d.alias("det"), x.alias("x"), (F.col("y") / 100).alias("y"), "z", x1.alias("x1"), y1.alias("y1"), (x1 + 100).alias("x2"), (y1 + 200).alias("y2"), F.lit("PERSON").alias("cls"))


@query()
def short_term_tracks(spark, sf):
    return folds.track(_scenes(spark, sf))


@query()
def track_statistics(spark, sf):
    return folds.track_statistics(_scenes(spark, sf))


@query()
def anonymous_tracks(spark, sf):
    return folds.anonymous(_scenes(spark, sf))


#: In the scaled clock of ``sync_events``: the slop, and how late every fourth image arrives.
SLOP, LATE = 1_800_000_000, 2_400_000_000


def sync_events(spark, sf):
    """Image (view) and scan (click) events, a scene for each day, nanoseconds scaled so that the slop is half an hour; every fourth image is late."""
    e = R.table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    scan = F.col("event_type") == "click"
    arrival = us + F.when(~scan & (F.col("event_id") % 4 == 0), LATE).otherwise(0)
    return e.select(F.floor(us / 86_400_000_000).alias("scene"), arrival.alias("arrival_ns"), F.when(scan, "lidar").otherwise("rgb").alias("topic"), F.col("event_id").alias("idx"), us.alias("ts_ns"))


@query(f"""WITH RECURSIVE t AS (SELECT epoch_us(ts) // 86400000000 AS scene, epoch_us(ts) AS t, event_type = 'click' AS scan, event_id AS idx FROM events WHERE event_type IN ('view', 'click')),
e AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY t + CASE WHEN NOT scan AND idx % 4 = 0 THEN {LATE} ELSE 0 END, CASE WHEN scan THEN 'lidar' ELSE 'rgb' END, idx) AS rn FROM t),
s AS (SELECT DISTINCT scene, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS img, CAST(NULL AS BIGINT) AS img_t, CAST(NULL AS BIGINT) AS pend, CAST(NULL AS BIGINT) AS pend_t, CAST(NULL AS BIGINT) AS lidar_idx, CAST(NULL AS BIGINT) AS rgb_idx, CAST(NULL AS BIGINT) AS age_ns FROM e
UNION ALL SELECT e.scene, e.rn, CASE WHEN scan THEN img ELSE idx END, CASE WHEN scan THEN img_t ELSE t END,
  CASE WHEN scan AND coalesce(t - img_t BETWEEN 0 AND {SLOP}, false) THEN pend WHEN scan THEN idx WHEN pend_t - t <= {SLOP} THEN NULL ELSE pend END,
  CASE WHEN scan AND coalesce(t - img_t BETWEEN 0 AND {SLOP}, false) THEN pend_t WHEN scan THEN t WHEN pend_t - t <= {SLOP} THEN NULL ELSE pend_t END,
  CASE WHEN scan THEN CASE WHEN t - img_t BETWEEN 0 AND {SLOP} THEN idx END WHEN pend_t - t BETWEEN 0 AND {SLOP} THEN pend END,
  CASE WHEN scan THEN CASE WHEN t - img_t BETWEEN 0 AND {SLOP} THEN img END WHEN pend_t - t BETWEEN 0 AND {SLOP} THEN idx END,
  CASE WHEN scan THEN CASE WHEN t - img_t BETWEEN 0 AND {SLOP} THEN t - img_t END WHEN pend_t - t BETWEEN 0 AND {SLOP} THEN pend_t - t END
  FROM s JOIN e ON e.scene = s.scene AND e.rn = s.rn + 1)
SELECT scene, lidar_idx, rgb_idx, age_ns FROM s WHERE lidar_idx IS NOT NULL""")  # fmt: skip
def runtime_slot_sync(spark, sf):
    """The one-slot pairing, which late images make different from the as-of join."""
    return folds.slot_sync(sync_events(spark, sf), SLOP)


def _motions(spark, sf):
    """Measurements of tracks every tenth of a second, and images between them."""
    t = folds.track(_scenes(spark, sf)).select("scene", "frame", "det", "track_id")
    rows = _scenes(spark, sf).join(t, ["scene", "frame", "det"])
    ns = F.col("frame") * 100_000_000
    m = rows.select("scene", ns.alias("ts_ns"), F.lit(1).alias("kind"), "track_id", "x", "y", "z")
    image = rows.select("scene", (ns + 33_000_000).alias("ts_ns"), F.lit(0).alias("kind")).distinct()
    return m.unionByName(image, allowMissingColumns=True)


@query()
def motion_snapshot(spark, sf):
    return folds.motion(_motions(spark, sf))


def _candidates(spark, sf):
    """Ordinary measurements of tracks, and every third time a component that suppression removed."""
    return _scenes(spark, sf).select("scene", "frame", F.col("det").cast("string").alias("track_id"), ((F.col("frame") + F.col("det")) % 3 != 0).alias("normal"), "x", "y", "z", (F.col("frame") % 9).cast("int").alias("n"), ((F.col("frame") % 7) / 5).alias("score"), F.lit(True).alias("inside"), (F.col("frame") % 5 != 0).alias("plausible"), F.lit(False).alias("competition"), (F.col("frame") % 8 == 0).alias("ambiguous"))


@query()
def recovery_decisions(spark, sf):
    return folds.recovery(_candidates(spark, sf))


_SHAPES = f"""{O.POINTS}, thirds AS (SELECT frame, pid % 3 + 1 AS det, count(*) AS n, CAST(sum(CAST(x AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mx, CAST(sum(CAST(y AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS my, greatest(max(x) - min(x), max(y) - min(y)) AS hspan, max(z) - min(z) AS vspan FROM points GROUP BY ALL),
s AS (SELECT frame // 50 AS scene, frame % 50 AS place, frame, det, det * 2 + frame % 7 / 1e1 + mx / 1e2 AS x, my / 1e2 AS y, hspan, vspan, n, mx / 1e1 AS cu, my / 1e1 AS cv, row_number() OVER (PARTITION BY frame // 50, det ORDER BY frame) AS k FROM thirds WHERE (frame + det) % 3 <> 0)"""


def _shaped(spark, sf):
    """Ordinary measurements of three tracks with their shapes, and every third time a component that suppression removed."""
    p = R.points(spark, sf).groupBy("frame", (F.pmod("pid", F.lit(3)) + 1).cast("int").alias("det"))
    p = p.agg(F.count(F.lit(1)).alias("n"), A.exact_mean("x").alias("mx"), A.exact_mean("y").alias("my"), F.avg("z").alias("z"), F.greatest(A.span("x"), A.span("y")).alias("hspan"), A.span("z").alias("vspan"))
    frame, det = F.col("frame"), F.col("det")
    return p.select(
        F.floor(frame / 50).alias("scene"), (frame % 50).alias("frame"), det.cast("string").alias("track_id"), ((frame + det) % 3 != 0).alias("normal"), (det * 2 + frame % 7 / 10 + F.col("mx") / 100).alias("x"), (F.col("my") / 100).alias("y"), "z",
        "n", ((frame % 7) / 5).alias("score"), F.lit(True).alias("inside"), (frame % 5 != 0).alias("plausible"), F.lit(False).alias("competition"), (frame % 8 == 0).alias("ambiguous"), "hspan", "vspan", (F.col("mx") / 10).alias("cu"), (F.col("my") / 10).alias("cv"),
    )


#: The frames of a scene on which limits are learnt, and how many changes they need here.
FIT, ENOUGH = "frame < 25", 5


_GAP = "(s.place - r.place)"


def _near(x: str) -> str:
    """An expression where the last measurement is not too old."""
    return f"CASE WHEN {_GAP} <= 10 THEN {x} END"


def _ratio(c: str) -> str:
    return _near(f"abs(ln(greatest(s.{c}, 1e-6) / greatest(CAST(r.{c} AS DOUBLE), 1e-6)))")


_NONE = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("innovation", "h", "v", "c", "du", "dv"))


@query(f"""WITH RECURSIVE {_SHAPES}, r AS (SELECT scene, det, k, place, x, y, hspan, vspan, n, cu, cv, 0e0 AS vx, 0e0 AS vy, {_NONE} FROM s WHERE k = 1
UNION ALL SELECT s.scene, s.det, s.k, s.place, s.x, s.y, s.hspan, s.vspan, s.n, s.cu, s.cv, coalesce({_near(f"0.72e0 * r.vx + 0.28e0 * (s.x - r.x) / {_GAP}")}, 0e0), coalesce({_near(f"0.72e0 * r.vy + 0.28e0 * (s.y - r.y) / {_GAP}")}, 0e0),
  {_near(f"sqrt(power(s.x - r.x - r.vx * {_GAP}, 2) + power(s.y - r.y - r.vy * {_GAP}, 2))")}, {_ratio("hspan")}, {_ratio("vspan")}, {_ratio("n")}, {_near("abs(s.cu - r.cu)")}, {_near("abs(s.cv - r.cv)")} FROM r JOIN s ON s.scene = r.scene AND s.det = r.det AND s.k = r.k + 1),
l AS (SELECT unnest(['{"', '".join(thresholds.MEASURES)}']) AS measure, unnest([innovation, h, v, c, du, dv]) AS value FROM r WHERE place < 25 AND innovation IS NOT NULL),
m AS (SELECT *, median(value) OVER (PARTITION BY measure) AS med FROM l), q AS (SELECT measure, count(*) AS n, least(quantile_cont(value, 0.99), greatest(any_value(med) + 3 * 1.4826e0 * median(abs(value - med)), quantile_cont(value, 0.9))) AS lim FROM m GROUP BY measure HAVING count(*) >= {ENOUGH})
SELECT measure, n, round(CASE WHEN measure = 'innovation' THEN least(lim, 1.2e0) ELSE lim END, 9) AS "limit" FROM q""")  # fmt: skip
def consistency_limits(spark, sf):
    """The limits of ordinary change in place and shape, frozen on the first frames of the scenes."""
    rows = _shaped(spark, sf).where("normal")
    return thresholds.frozen(thresholds.changes(rows), FIT, ENOUGH).select("measure", "n", F.round("limit", 9).alias("limit"))


@query()
def strict_recovery_decisions(spark, sf):
    """Decisions on candidates under the frozen limits."""
    rows = _shaped(spark, sf)
    limits = thresholds.limits_of(thresholds.frozen(thresholds.changes(rows.where("normal")), FIT, ENOUGH))
    return folds.recovery(rows, limits=limits)


def _people(spark, sf):
    """Tracks that are named like identities for twenty frames, and vanish now and then."""
    s = _scenes(spark, sf).where((F.col("frame") % 6) != F.col("det"))
    look = F.when(F.col("det") == 1, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    name = F.when(F.col("frame") < 20, F.format_string("G%02d", F.col("det"))).otherwise(F.format_string("T%04d", F.col("det")))
    return s.select("scene", (F.col("frame") * 100_000_000 + 1).alias("ts_ns"), name.alias("track_id"), "x", "y", "z", look.alias("vector"))


@query()
def identity_events(spark, sf):
    return folds.identities(_people(spark, sf), KNOWN)
