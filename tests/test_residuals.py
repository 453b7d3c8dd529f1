"""The residual audit's states on scenes whose offset is known."""

import random

from fusegrid.operators.residuals import CHECKS, residual_audit

SAMPLES = "scene long, frame long, residual double, depth double, u double"


def scene(n, scans, offset, noise=1.0, drift=0.0, seed=0):
    rng = random.Random(seed)
    return [(n, f, offset + drift * f + rng.gauss(0, noise), rng.uniform(1, 12), rng.uniform(0, 1280)) for f in range(scans) for _ in range(6)]


def audited(spark, rows, scans, warmup=60):
    frames = [(n, f) for n, k in scans.items() for f in range(k)]
    return {r.scene: r for r in residual_audit(spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(frames, "scene long, frame long"), warmup).collect()}


def test_states_of_scenes(spark):
    rows = scene(1, 80, 16.4) + scene(2, 80, 0.2) + scene(3, 59, 16.0) + scene(4, 80, 10.0, drift=1.5) + [(5, f, float("nan"), 3.0, 9.0) for f in range(80)] + [(7, f, 16.0, 3.0, 9.0) for f in range(17)]
    got = audited(spark, rows, {1: 80, 2: 80, 3: 59, 4: 80, 5: 80, 6: 70, 7: 70})
    assert {k: r.state for k, r in got.items()} == {1: "PASS", 2: "FAIL", 3: "WARMUP", 4: "FAIL", 5: "FAIL", 6: "FAIL", 7: "FAIL"}
    one = got[1]
    assert one.candidate == 16.0 and abs(one.dynamic_du - 16.4) < 0.5 and one.dynamic_frames == 60 and one.improvement > 0.9 and all(one[c] for c in CHECKS)
    assert got[2].candidate == 0.0 and not got[2].holdout_improved and got[2].block_stable
    assert not got[4].block_stable and got[3].candidate is None and got[3].enough_frames is None
    assert got[5].dynamic_frames == 0 and not any(got[5][c] for c in CHECKS)
    assert not got[7].enough_frames and not got[7].depth_consistent  # one depth and region only


def test_later_scans_change_nothing(spark):
    rows = scene(1, 60, 16.4)
    late = [(1, f, -70.0, 3.0, 600.0) for f in range(60, 200)]
    a, b = audited(spark, rows, {1: 60})[1], audited(spark, rows + late, {1: 200})[1]
    assert a.asDict() | {"scans": 0} == b.asDict() | {"scans": 0} and a.state == "PASS"


def test_offset_is_kept_inside_the_search(spark):
    assert audited(spark, scene(1, 60, 500.0), {1: 60})[1].candidate == 120.0
