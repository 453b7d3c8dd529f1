"""Functions that no registered query calls: expressions against plain arithmetic, readers and sinks by round trip."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusegrid.functions import boxes as B
from fusegrid.functions import geometry as G
from fusegrid.operators import assign, audit, windows
from fusegrid.sources import readers
from fusegrid.streaming import states as S
from fusegrid.streaming.recovery import shape_gaps


def test_runtime_gate_fails_by_each_check_alone(spark):
    good = {"output_hz": 30.0, "processed_fraction": 0.99, "lidar_hz": 10.0, "lidar_p95_ms": 99.0, "wall_ratio": 1.0, "queue_growth": False, "render_depth": 1, "video_depth": 12, "recording": True, "video_dropped": 0, "video_written": 9, "processed": 9}
    good |= dict.fromkeys(("future_reads", "repeated_timestamps", "unknown_sources", "duplicate_identities", "robot_z_rows", "robot_rows", "other_ids"), 0) | dict.fromkeys(("rgb_count", "rgb_expected", "lidar_count", "lidar_expected"), 5) | {"reid": False, "persistent": False}
    bad = {"output_hz": 28.9, "processed_fraction": 0.98, "lidar_hz": 9.4, "lidar_p95_ms": 100.0, "video_depth": 13, "video_dropped": 1, "future_reads": 1, "repeated_timestamps": 1, "unknown_sources": 1, "duplicate_identities": 1, "robot_z_rows": 1, "rgb_count": 4, "wall_ratio": 1.2, "robot_rows": 1, "reid": True, "persistent": True, "other_ids": 1}
    names = list(good)
    rows = [tuple(good.values())] + [tuple((good | {k: v}).values()) for k, v in bad.items()] + [tuple((good | {"lidar_p95_ms": None}).values())]
    d = spark.createDataFrame(rows, names)
    checks = audit.runtime_checks(realtime=True, lightweight=True)
    got = audit.gate(d, checks).withColumn("status", audit.run_status(F.col("passed"), F.lit(False), realtime=True, full=True)).collect()
    assert len(checks) == 17 == len(bad) and got[0].passed and got[0].status == "PURE_ONLINE_FULL_REALTIME_PASS"
    for row, name in zip(got[1:-1], checks, strict=True):
        assert not row.passed and [c for c in checks if not row[c]] == [name] and row.status.endswith("_FAIL")
    assert not got[-1].passed and not got[-1].lidar_p95_pass


def test_many_matrices_equal_permutations():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 7), range(1, 7)):
        costs = rng.random((5, n, m))
        k, r, c = assign.solve_many(costs)
        for i, cost in enumerate(costs):
            total = cost[r[k == i], c[k == i]].sum()
            wide = cost if n <= m else cost.T
            best = min(sum(wide[a, b] for a, b in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
            assert total == pytest.approx(best) and (k == i).sum() == min(n, m) == len({*r[k == i]}) == len({*c[k == i]})


def test_assignment_of_groups_with_nulls_and_fills(spark):
    rows = [(None, 1, "a", 1.0), (None, 1, "b", 2.0), (None, 2, "a", 0.5), (2**60 + 1, 1, "a", 3.0), (2**60 + 2, 1, "a", None)]
    d = spark.createDataFrame(rows, "g long, l long, r string, cost double").repartition(3)
    got = sorted(map(tuple, assign.assign(d, ["g"], "l", "r", "cost", 9.0, 9.0).collect()), key=str)
    # without the missing pair (2, b) the optimum is 1-b and 2-a
    assert got == sorted([(None, 1, "b", 2.0), (None, 2, "a", 0.5), (2**60 + 1, 1, "a", 3.0), (2**60 + 2, 1, "a", 9.0)], key=str)
    with pytest.raises(Exception, match="finite"):
        assign.assign(d, ["g"], "l", "r", "cost", None, 9.0).collect()
    assert assign.assign(d.limit(0), ["g"], "l", "r", "cost", 9.0, 9.0).count() == 0


def test_running_total_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 3 == 0 else "k", float(x), int(v)) for i, (x, v) in enumerate(zip(rng.permutation(500), rng.integers(0, 9, 500)))]
    got = windows.running_total(spark.createDataFrame(rows, "k string, x double, v long"), ["k"], ["x"], "v", "t").collect()
    for key in (None, "k"):
        want = np.cumsum([v for k, _, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])])
        assert [r.t for r in sorted((r for r in got if r.k == key), key=lambda r: r.x)] == want.tolist()


def test_costs_and_gates_equal_their_state_machine_twins(spark):
    rows = [(d, g, o) for d in (None, 0.0, 0.5, 0.88, 1.2, 3.0) for g in (0, 1, 3, 9) for o in (0.0, 0.1, 0.6)]
    t = spark.createDataFrame(rows, "d double, g int, o double")
    for r in t.select("*", B.track_cost("d", "g", "o").alias("cost"), B.identity_gate(F.col("g") / 4).alias("gate")).collect():
        gate = S.motion_gate(r.g)
        want = (0.7 + 0.3 * (1 - r.o) if r.o >= 0.1 else None) if r.d is None else 0.75 * r.d / gate + 0.25 * (1 - r.o) if r.d <= gate else None
        assert r.cost == (want if want is None else pytest.approx(want)) and r.gate == pytest.approx(min(3.0, 0.75 + 1.5 * r.g / 4))


def test_small_expressions(spark):
    one = spark.range(1)
    x, y, w, h = (F.lit(float(k)) for k in (3, 4, 10, 20))
    box = B.to_xyxy(x, y, w, h)
    got = one.select(*[c.alias(f"a{i}") for i, c in enumerate(box)], *[c.alias(f"b{i}") for i, c in enumerate(B.to_xywh(box))], B.log_ratio(F.lit(2), F.lit(0)).alias("r"), B.size_bin(F.lit(99)).alias("s")).first()
    assert tuple(got[:8]) == (3, 4, 13, 24, 3, 4, 10, 20) and got.r == pytest.approx(next(shape_gaps((2, 1, 1, 0, 0), (0, 1, 1, 0, 0)))) and got.s == "small"
    cells = [(i, j, k) for i in (-3, 0, 7) for j in (-1, 2) for k in (-5, 5)]
    d = spark.createDataFrame(cells, "i int, j int, k int")
    assert d.select(G.cell_code("i", "j", "k").alias("c")).distinct().count() == len(cells)
    d = spark.createDataFrame([(2, 9), (9, 2), (2, 2)], "t int, o int")
    assert [r[0] for r in d.select(audit.suppression_detail(F.col("t"), F.col("o"))).collect()] == ["D1_TEMPORAL", "D2_OCCUPANCY", "D3_BOTH"]


def test_sinks_and_metric_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False)], "frame long, processed boolean")
    for _ in range(2):
        readers.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    readers.write_summary({"b": 1, "a": 2.5}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 2.5, "b": 1}
    readers.write_report({"tp": 3}, str(tmp_path / "r.md"), "Run")
    assert "| tp | 3 |" in (tmp_path / "r.md").read_text()
    (tmp_path / "m.csv").write_text("tp,f1\n3,0.5\n")
    assert readers.read_metrics_csv(spark, str(tmp_path / "m.csv"), "tp int, f1 double").first() == (3, 0.5)


def test_frozen_prior_and_prototypes(spark, tmp_path):
    prior = spark.createDataFrame([(0, 0, 0, 9), (1, 0, 0, 2)], "kx int, ky int, kz int, n_frames long")
    prior.write.parquet(str(tmp_path / "p"))
    receipt = {"fit_scope": "TRAIN_FIT", "frame_count": 10, "sha256": readers.content_sha256(prior, ["kx", "ky", "kz"], ["kx", "ky", "kz", "n_frames"])}
    assert [r.kx for r in readers.frozen_prior(spark, str(tmp_path / "p"), receipt, 0.65).collect()] == [0]
    for bad in ({"sha256": "0"}, {"fit_scope": "VALIDATION"}, {"validation_updates": 1}):
        with pytest.raises(ValueError, match="prior"):
            readers.frozen_prior(spark, str(tmp_path / "p"), receipt | bad, 0.65)
    spark.createDataFrame([("G01", [1.0, 0.0], "TRAIN_FIT")], "name string, vector array<double>, fit_scope string").write.parquet(str(tmp_path / "v"))
    assert readers.prototypes(spark, str(tmp_path / "v")).count() == 1
    spark.createDataFrame([("G01", [1.0, 0.0], "TEST")], "name string, vector array<double>, fit_scope string").write.mode("append").parquet(str(tmp_path / "v"))
    with pytest.raises(Exception, match="another scope"):
        readers.prototypes(spark, str(tmp_path / "v")).collect()
    t = spark.createDataFrame([(1, "True"), (1, "True"), (2, "True"), (2, "False")], "frame long, gt_valid string")
    assert readers.valid_targets(t, t.select("frame").where("frame = 1").distinct(), 2).count() == 2
    with pytest.raises(Exception, match="targets"):
        readers.valid_targets(t, t.select("frame").distinct(), 2).collect()


def test_detections_of_one_class(spark):
    d = spark.createDataFrame([(0,), (16,)], "c int")
    assert windows.of_class(d, {0: "person", 16: "dog"}, "person", "c").count() == 1
    with pytest.raises(ValueError, match="2 classes"):
        windows.of_class(d, {0: "person", 1: "person"}, "person", "c")
