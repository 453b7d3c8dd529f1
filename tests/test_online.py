"""The online path: single steps, batch against stream for cuts inside units, and its counters."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fusegrid.functions import geometry as G
from fusegrid.functions import model as M
from fusegrid.plans import queries_online as Q
from fusegrid.streaming import online
from fusegrid.streaming import queries as SQ
from fusegrid.streaming.folds import END

SF = "/root/testdata/sf0.001"
LOOKS = {"G01": (1.0, 0.0), "G02": (0.0, 1.0)}
MS = 1_000_000


def seen(det, x=None, box=(10, 10, 30, 50), cls="PERSON", conf=0.9, look=None, candidate=None):
    return online.Seen(det, cls, conf, tuple(map(float, box)), None if x is None else (x, 0.0, -1.0), look, candidate)


def tracks(path, ns, *rows):
    return [r["track_id"] for r in path.scan(ns, list(rows)) if r["det"] >= 0]


def test_temporary_track_takes_an_identity_and_keeps_its_motion():
    p = online.Path(prototypes=LOOKS)
    assert tracks(p, 100 * MS, seen(0, 1.0)) == ["T0001"]
    assert tracks(p, 200 * MS, seen(0, 1.1)) == ["T0001"]
    velocity, birth = p.tracks["T0001"].velocity, p.tracks["T0001"].birth
    assert tracks(p, 300 * MS, seen(0, 1.2, look=(0.9, 0.1))) == ["G01"]
    assert "T0001" not in p.tracks and p.tracks["G01"].birth == birth and p.tracks["G01"].velocity[0] > velocity[0] > 0
    # the identity is taken now: another person of the same look gets a name of their own
    assert tracks(p, 400 * MS, seen(0, 1.3), seen(1, 5.0, (400, 10, 430, 60), look=(1.0, 0.0))) == ["G01", "T0002"]


def test_identities_are_given_by_the_best_match_and_its_limit():
    p = online.Path(prototypes=LOOKS)
    assert tracks(p, 100 * MS, seen(0, 1.0, look=(0.8, 0.6)), seen(1, 5.0, (400, 10, 430, 60), look=(1.0, 0.0))) == ["G02", "G01"]
    q = online.Path(prototypes=LOOKS)
    assert tracks(q, 100 * MS, seen(0, 1.0, look=(0.51, 0.51)), seen(1, 5.0, (400, 10, 430, 60))) == ["T0001", "T0002"]
    assert tracks(q, 200 * MS, seen(0, 1.0, look=(0.52, 0.0)), seen(1, 5.0, (400, 10, 430, 60))) == ["G01", "T0002"]


def test_best_robot_is_r1_and_classes_never_match():
    p = online.Path(prototypes=LOOKS)
    assert tracks(p, 100 * MS, seen(0, 1.0, cls="ROBOT", conf=0.5), seen(1, 3.0, (90, 10, 120, 50), "ROBOT", 0.7)) == ["T0001", "R1"]
    assert tracks(p, 200 * MS, seen(0, 3.0, (90, 10, 120, 50))) == ["T0002"]  # a person where the robot was
    assert tracks(p, 300 * MS, seen(0, 9.0, (700, 10, 720, 50), "ROBOT")) == ["R1"]  # taken though nothing matched
    with pytest.raises(ValueError, match="persons"):
        online.Path().scan(100 * MS, [seen(0, 1.0, cls="ROBOT")])


def test_height_keeps_its_velocity_with_identities_only():
    rows = [online.Seen(0, "PERSON", 0.9, (10.0, 10.0, 30.0, 50.0), (1.0, 0.0, z), None, None) for z in (0.0, 0.5)]
    for prototypes, vertical in ((LOOKS, 0.14), (None, 0.0)):
        p = online.Path(prototypes=prototypes)
        for i, r in enumerate(rows):
            p.scan((i + 1) * MS, [r])
        assert p.tracks["T0001"].velocity[2] == pytest.approx(vertical) and p.motions["T0001"].velocity[2] == 0.0


def test_accepted_candidates_stand_in_for_positions():
    c = {"xyz": (1.1, 0.0, -1.0), "n": 9, "score": 0.4, "inside": True, "plausible": True, "competition": False, "ambiguous": False}
    p = online.Path(recover=True)
    p.scan(100 * MS, [seen(0, 1.0)])
    counts, row = p.scan(200 * MS, [seen(0, candidate=c)])
    assert (counts["recovery_attempts"], counts["recovery_accepted"], counts["measurements"]) == (1, 1, 1)
    assert row["measurement_source"] == "RECOVERED_SUPPRESSED_COMPONENT" and p.tracks["T0001"].xyz == (1.1, 0.0, -1.0) and p.motions["T0001"].ns == 200 * MS
    counts, row = p.scan(300 * MS, [seen(0, candidate=c | {"n": 2})])
    assert (counts["recovery_attempts"], counts["recovery_rejected"], counts["measurements"]) == (1, 1, 0) and row["measurement_source"] == "UNAVAILABLE"
    assert online.Path().scan(100 * MS, [seen(0, candidate=c)])[0]["recovery_attempts"] == 0


def at_pixel(path, name, ns):
    return online.pixel(*path._ahead(path.motions[name], ns))


def test_image_takes_the_least_cost_and_reports_a_measurement_once():
    p = online.Path()
    p.scan(100 * MS, [seen(0, 3.0)])
    u, v = at_pixel(p, "T0001", 120 * MS)
    near, far = (u - 40, v - 80, u + 40, v + 80), (u + 300, v, u + 380, v + 160)
    rows = p.image(120 * MS, [seen(0, box=far), seen(1, box=near)])
    assert [(r["det"], r["track_id"], r["state_source"], r["state_status"]) for r in rows] == [(1, "T0001", "LIDAR_MEASUREMENT", "FRESH")]
    assert p.image(140 * MS, [seen(0, box=near)])[0]["state_source"] == "CAUSAL_PREDICTION"
    assert p.image(290 * MS, [seen(0, box=near)]) == []  # 190 ms ahead is not fresh
    # the far box was anonymous, and its id used up
    assert sorted(p.boxes) == ["A0001", "A0002"]


def test_image_with_identities_reports_stale_and_unknown_rows():
    p = online.Path(prototypes=LOOKS)
    p.scan(100 * MS, [seen(0, 3.0, cls="ROBOT")])
    rows = p.image(500 * MS, [seen(0, cls="ROBOT", conf=0.2), seen(1, (0.0), (500, 10, 530, 60), "ROBOT", 0.8), seen(2, None, (700, 10, 730, 60))])
    assert [(r["track_id"], r["state_status"], r["x"]) for r in rows] == [("A0001", "UNAVAILABLE", None), ("R1", "STALE", None), ("A0002", "UNAVAILABLE", None)]
    assert rows[1]["identity"] == "R1" and rows[1]["horizon_ms"] == 400.0 and p.motions["R1"].conf == 0.8


def test_association_is_the_cheapest_of_all_ways():
    rng = random.Random(3)
    for _ in range(60):
        p = online.Path()
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        p.scan(100 * MS, [seen(i, 3.0 + i, (200 * i, 10, 200 * i + 40, 90)) for i in range(n)])
        names = sorted(p.motions)
        spots = [at_pixel(p, k, 120 * MS) for k in names]
        boxes = [(u - 40 + rng.uniform(-60, 60), v - 80 + rng.uniform(-60, 60)) for u, v in (rng.choice(spots) for _ in range(m))]
        boxes = [(a, b, a + 80, b + 160) for a, b in boxes]
        cost = [[online.box_cost(s, b) for b in boxes] for s in spots]
        ways = [w for w in itertools.product(range(-1, m), repeat=n) if len({x for x in w if x >= 0}) == sum(x >= 0 for x in w)]
        best = min(ways, key=lambda w: sum(cost[i][x] if x >= 0 else M.ASSOCIATION_DUMMY for i, x in enumerate(w)))
        want = {(x, names[i]) for i, x in enumerate(best) if x >= 0 and cost[i][x] <= M.ASSOCIATION_LIMIT}
        assert {(r["det"], r["track_id"]) for r in p.image(120 * MS, [seen(j, box=b) for j, b in enumerate(boxes)])} == want


def test_pixel_equals_the_column_form(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-1, 9), rng.uniform(-4, 4), rng.uniform(-2, 2)) for _ in range(200)]
    d = G.with_projection(spark.createDataFrame(points, "x double, y double, z double"), shift="inference")
    for r in d.collect():
        p = online.pixel(r.x, r.y, r.z)
        assert (p is None) == (not r.valid) and (p is None or p == pytest.approx((r.u, r.v), rel=1e-9))


def test_causal_order_of_scans():
    p = online.Path()
    p.scan(100, [])
    with pytest.raises(ValueError, match="increasing"):
        p.scan(100, [])


def recording(spark):
    """Three scenes of people and robots that come and go, with looks, candidates, empty units and gaps."""
    rng, rows = random.Random(11), []
    for scene in range(3):
        place = {k: rng.uniform(1, 8) for k in range(4)}
        for t in range(25):
            for ns, kind in ((100 * t, 1), (100 * t + 33, 0), (100 * t + 66, 0)):
                if rng.random() < 0.1:
                    continue
                row = {"scene": scene, "ns": (ns + 100) * MS, "kind": kind}
                there = [k for k in place if rng.random() < 0.8]
                rows += [row | {"det": -1}] if not there else []
                for det, k in enumerate(there):
                    place[k] += rng.uniform(-0.1, 0.1)
                    u, v = online.pixel(place[k], k - 1.5, -1.0)
                    r = row | {"det": det, "cls": "ROBOT" if k == 3 else "PERSON", "conf": round(rng.random(), 3), "x1": u - 40, "y1": v - 80, "x2": u + 40, "y2": v + 80}
                    if kind == 1:
                        r |= {"x": place[k], "y": k - 1.5, "z": -1.0} if rng.random() < 0.7 else {"rn": 5.0, "rx": place[k], "ry": k - 1.5, "rz": -1.0, "rscore": 0.5, "rinside": True, "rplausible": True, "rcompetition": False, "rambiguous": rng.random() < 0.2}
                        r |= {"vector": list(LOOKS[f"G0{k + 1}"])} if k < 2 and rng.random() < 0.5 else {}
                    rows.append(r)
    return spark.createDataFrame([tuple(r.get(c) for c in online.COLUMNS) for r in rows], online.SIGHTING)


def streamed(spark, rows, tmp_path, cuts, **options):
    folder = tmp_path / "in"
    last = rows.dropDuplicates(["scene"]).withColumn("ns", F.lit(END))
    for i, part in enumerate([*(rows.where(c) for c in cuts), last]):
        part.coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*"):
            if not f.name.startswith("part-cut"):
                f.rename(folder / f"part-cut{i:03d}.parquet")
    stream = SQ.read_parquet_stream(spark, str(folder), rows.schema, 1)
    with SQ.with_rocksdb(spark):
        return SQ.run_once(online.stream(stream, **options), str(tmp_path / "out"), str(tmp_path / "check"))


def collected(d):
    return sorted(map(tuple, d.collect()), key=str)


#: cuts between units, inside a scan and inside an image
CUTS = ["ns < 400e6", "ns >= 400e6 and (ns < 700e6 or ns = 700e6 and det < 1)", "ns = 700e6 and det >= 1 or ns > 700e6 and ns < 1833e6", "ns = 1833e6 and det < 2", "ns = 1833e6 and det >= 2 or ns > 1833e6"]


def test_path_by_stream_equals_batch(spark, tmp_path):
    rows, options = recording(spark), {"prototypes": LOOKS, "recover": True}
    want = collected(online.batch(rows.repartition(7), **options))
    got = collected(streamed(spark, rows, tmp_path, CUTS, **options))
    assert got == want and {r[2] for r in want} == {0, 1}
    names = {r[4] for r in want}
    assert {"G01", "G02", "R1"} <= names and any(n and n[0] == "T" for n in names) and any(n and n[0] == "A" for n in names)
    assert {"LIDAR_MEASUREMENT", "CAUSAL_PREDICTION"} <= {r[12] for r in want} and "RECOVERED_SUPPRESSED_COMPONENT" in {r[15] for r in want}


def test_late_rows_of_a_stream_are_counted_and_left_out(spark, tmp_path):
    rows, options = recording(spark), {"prototypes": LOOKS}
    late = "scene = 1 and ns between 500e6 and 600e6"
    n = rows.where(late).count()
    got = collected(streamed(spark, rows, tmp_path, [f"not ({late})", late], **options))
    assert [r[-2] for r in got if r[2] == online.LATE] == [n] and n > 0
    assert [r for r in got if r[2] != online.LATE] == collected(online.batch(rows.where(f"not ({late})"), **options))


def test_variants_side_by_side_equal_runs_of_their_own(spark, tmp_path):
    rows = recording(spark)
    options = {"plain": {}, "recovering": {"recover": True}, "aware": {"prototypes": LOOKS}, "mirror": {}}
    plain = rows.where("cls <> 'ROBOT' or cls is null")
    shared = plain.withColumn("variant", F.lit("a")).unionByName(rows.withColumn("variant", F.lit("b")))
    fanned = online.fan_out(shared, {"a": ["plain", "recovering", "mirror"], "b": ["aware"]})
    got = online.batch(fanned, options)
    for name, own in options.items():
        alone = online.batch(rows if name == "aware" else plain, **own)
        assert collected(got.where(F.col("variant") == name).drop("variant")) == collected(alone.drop("variant"))
    differing = {(r.left, r.right): r.differing for r in online.mirrors(got, [("plain", "mirror"), ("plain", "recovering")]).collect()}
    assert differing["plain", "mirror"] == 0 < differing["plain", "recovering"]
    folder = tmp_path / "in"
    for part in ("ns < 900e6", "ns >= 900e6"):
        fanned.where(part).coalesce(1).write.mode("append").parquet(str(folder))
    fanned.dropDuplicates(["scene", "variant"]).withColumn("ns", F.lit(END)).coalesce(1).write.mode("append").parquet(str(folder))
    with SQ.with_rocksdb(spark):
        stream = online.stream(SQ.read_parquet_stream(spark, str(folder), fanned.schema, 1), options)
        out = SQ.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert collected(out) == collected(got)


def test_policies_that_mean_the_same_stay_the_same(spark):
    rows = Q.variant_rows(spark, SF).persist()
    try:
        assert {r.differing for r in online.mirrors(rows, Q.MIRRORED).collect()} == {0}
        legacy = rows.where("variant = 'LEGACY' and det = -1").agg(F.sum("measurements")).first()[0]
        assert legacy == Q.scan_counters(spark, SF).agg(F.sum("measurements")).first()[0]
        assert rows.select("variant").distinct().count() == 2 * len(M.POLICIES)
    finally:
        rows.unpersist()


def test_path_over_an_empty_table(spark):
    assert online.batch(spark.createDataFrame([], online.SIGHTING)).collect() == []


def test_scan_counters_add_up(spark):
    both = Q.online_scan_counters(spark, SF).alias("a").join(Q.scan_counters(spark, SF).alias("b"), "frame")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in Q.GEOMETRIC[:-1]] + [F.col("a.measurements") == F.col("b.measurements") + F.col("recovery_accepted")]
    rows = both.select(*[s.alias(f"s{i}") for i, s in enumerate(same)], (F.col("recovery_attempts") == F.col("recovery_accepted") + F.col("recovery_rejected")).alias("sum"), (F.col("a.points_height_candidate") == F.col("a.temporal_removed") + F.col("a.occupancy_removed") + F.col("a.points_after_static")).alias("static")).collect()
    assert rows and all(all(r) for r in rows)
