"""Operators and decoders on literal inputs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusegrid.functions import boxes as B
from fusegrid.functions import geometry as G
from fusegrid.functions import model as M
from fusegrid.operators import assign, audit, cluster, joins, windows
from fusegrid.plans.components import connected_components
from fusegrid.sources import readers


def one(df, *columns):
    return df.select(*columns).first()


def test_projection_without_distortion_terms(spark, monkeypatch):
    monkeypatch.setattr(M, "DISTORTION", (0.0,) * 5)
    for k, v in (("FX", 600.0), ("FY", 600.0), ("CX", 640.0), ("CY", 360.0)):
        monkeypatch.setattr(M, k, v)
    df = spark.createDataFrame([(0.2, -0.1, 4.0), (0.0, 0.0, 2.0), (0.0, 0.0, -1.0), (float("nan"), 0.0, 1.0)], "x double, y double, z double")
    got = [tuple(r) for r in G.with_projection(df, t=np.eye(4), shift="inference").select("u", "v", "valid").collect()]
    assert got == [(pytest.approx(734.0), pytest.approx(381.0), True), (704.0, 396.0, True), (None, None, False), (None, None, False)]


def test_ground_height_of_a_long_normal(spark):
    df = spark.createDataFrame([(0.0, 0.0, -1.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    got = [r[0] for r in df.select(G.ground_height("x", "y", "z", (0.0, 0.0, 2.0), 2.0, True)).collect()]
    assert got == [0.0, 1.0]
    with pytest.raises(ValueError):
        G.ground_height("x", "y", "z", (0.0, 0.0, 0.0), 1.0, True)


def test_causal_age(spark):
    df = spark.createDataFrame([(65_000_000, 100_000_000)], "r long, l long")
    assert one(df, G.causal_age_ms("r", "l"))[0] == 35.0
    with pytest.raises(Exception, match="future RGB"):
        one(df, G.causal_age_ms("l", "r"))
    with pytest.raises(Exception, match="synchronization"):
        one(df, G.causal_age_ms(F.col("r") - 1_000_000, "l"))


def test_iou(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 0.0, 3.0, 2.0)], "a_x1 double, a_y1 double, a_x2 double, a_y2 double, b_x1 double, b_y1 double, b_x2 double, b_y2 double")
    assert one(df, B.iou(B.box("a_"), B.box("b_")))[0] == pytest.approx(1 / 3)


def test_policies(spark):
    rows = [(p, 0.1, 0.2, True, True, True) for p in M.POLICIES]
    df = spark.createDataFrame(rows, "policy string, z double, h double, near boolean, temporal boolean, owned boolean")
    got = dict(df.select("policy", audit.occupancy_keep(F.col("policy"), "z", "h", "near", "temporal", "owned")).collect())
    assert got == {"LEGACY": False, "PHYSICAL_DIRECT": False, "GROUND_LIMITED": False, "HEIGHT_BANDED": False, "TEMPORAL_PRIMARY_OCCUPANCY_SECONDARY": True, "PERSON_CONDITIONAL_PROTECTION": True}
    with pytest.raises(Exception, match="unknown occupancy policy"):
        df.select(audit.occupancy_keep(F.lit("NONE"), "z", "h", "near", "temporal", "owned")).collect()


def test_guards(spark):
    df = spark.createDataFrame([("TRAIN_FIT", 0), ("TEST", 1)], "split string, i int")
    with pytest.raises(Exception, match="must not be reached"):
        audit.guard_splits(df, ["TRAIN_FIT"]).collect()
    assert audit.contiguous(df, "i").first()["contiguous"]


def test_gate_after_the_optimum(spark):
    rows = [(0, 0, 0, 1.0), (0, 0, 1, 1.2), (0, 1, 0, 1.1), (0, 1, 1, 9.0)]
    df = spark.createDataFrame(rows, "frame long, a int, b int, cost double")
    got = {(r.a, r.b) for r in assign.assign(df, ["frame"], "a", "b", "cost", None, 1.5).collect()}
    assert got == {(0, 1), (1, 0)}
    dummies = assign.with_dummies(df, ["frame"], "a", "b", "cost", 1.25)
    assert assign.assign(dummies, ["frame"], "a", "b", "cost", 1.25, 1.15).where("b >= 0").count() <= 2


def test_components_use_the_lower_points_radius():
    far = np.array([[10.0, 0.0, 0.0], [10.3, 0.0, 0.0], [0.0, 0.0, 0.0], [0.19, 0.0, 0.0]])
    assert cluster.component_labels(far).tolist() == [0, 0, 2, 3]
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 3, (300, 3))
    assert (cluster.component_labels(x, 7) == cluster.component_labels(x)).all()


def test_greedy_suppression(spark):
    rows = [(0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.8, 0.5, 0.0, 10.5, 10.0), (0, 2, 0.7, 50.0, 50.0, 60.0, 60.0), (0, 3, 0.1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "frame long, det int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.det for r in windows.kept_boxes(df).collect()) == [0, 2]


def test_asof_tolerance_is_inclusive(spark):
    left = spark.createDataFrame([(0, 100), (1, 300)], "idx int, ts long")
    right = spark.createDataFrame([(7, 64), (8, 65), (9, 101)], "r int, rt long")
    one = lambda d: d.withColumn("k", F.lit(1))
    assert [(r.idx, r.r) for r in joins.asof_backward(one(left), one(right), "ts", "rt", 35, ["k"]).collect()] == [(0, 8)]
    assert [(r.idx, r.r) for r in joins.bucketed_asof(left, right, "ts", "rt", 35).collect()] == [(0, 8)]
    with pytest.raises(ValueError):
        joins.asof_backward(left, right, "ts", "rt", 35)


def test_latest_without_a_limit_carries_columns_over_buckets(spark):
    left = spark.createDataFrame([(0, 5), (1, 100), (2, 100_000), (3, 101)], "idx int, ts long")
    right = spark.createDataFrame([(7, 6), (8, 100), (9, 100)], "r int, ts long")
    got = joins.asof_latest(left, right, 10, ["r"]).collect()
    assert sorted((r.idx, r.r, r.age) for r in got) == [(1, 9, 0), (2, 9, 99_900), (3, 9, 1)]


def test_even_sample_of_a_whole_table_equals_the_keyed_one(spark):
    for n in (0, 1, 19, 20, 21, 1000):
        d = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 37 % 1009).alias("ts"))
        a = sorted(r.idx for r in windows.even_sample_of_all(d, ["ts"], 20).collect())
        b = sorted(r.idx for r in windows.even_sample(d.withColumn("k", F.lit(0)), ["k"], "ts", 20).collect())
        assert a == b and len(a) == min(n, 20)


def test_nearest_of_any_distance_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    points = lambda n, f: [(f, i, float(u), float(v)) for i, (u, v) in enumerate(rng.normal(0, 3, (n, 2)))]
    left = points(60, 0) + [(0, 100, 5000.0, 0.0), (0, 101, float("nan"), 0.0), (0, 102, None, 1.0)] + points(4, 1) + points(3, 2)
    right = points(200, 0) + [(0, 300, 4000.0, 900.0), (0, 301, 1.0, 1.0), (0, 302, 1.0, 1.0)] + [(1, 0, 7.0, 7.0)]
    l, r = (spark.createDataFrame(x, f"frame int, {n} int, u double, v double") for x, n in ((left, "a"), (right, "b")))  # noqa: E741
    want = []
    for f, i, u, v in left:
        if u is not None and u == u:
            near = sorted((np.hypot(u - x, v - y), j) for g, j, x, y in right if g == f)[:3]
            want += [(f, i, j, pytest.approx(float(d)), k + 1) for k, (d, j) in enumerate(near)]
    for radius in (0.05, 1.0, 1e5):
        got = sorted((x.frame, x.a, x.b, x.distance, x["rank"]) for x in joins.nearest_of(l, r, ["frame"], "a", "b", 3, radius).collect())
        assert got == sorted(want, key=lambda x: (x[0], x[1], x[2]))
    assert joins.nearest_of(l.where("a < 0"), r, ["frame"], "a", "b", 3, 1.0).collect() == []


def test_backlog_streams_one_worker_a_key(spark):
    rows = [("a", 0.0, 5.0), ("a", 1.0, 5.0), ("a", 2.0, 5.0), ("a", 9.0, 1.0), ("b", 0.0, 1.0), ("b", 0.5, 1.0)]
    got = windows.backlog_drops(spark.createDataFrame(rows, "k string, due double, cost double"), ["k"], "due", "cost", 4.0).collect()
    assert sorted(map(tuple, got)) == [("a", 0.0, True), ("a", 1.0, True), ("a", 2.0, False), ("a", 9.0, True), ("b", 0.0, True), ("b", 0.5, True)]


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(None, 4), (5, 5)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cloud_and_pcd_decoders(spark, tmp_path):
    body = b"".join(struct.pack("<fffxxxx", *p) for p in ((1, 2, 3), (float("nan"), 0, 0), (4, 5, 6)))
    fields = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7)]
    assert readers.decode_cloud(body, fields, 3, 1, 16, 48, False).tolist() == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(ValueError, match="lacks"):
        readers.decode_cloud(body, fields[:2], 3, 1, 16, 48, False)
    head = b"# .PCD\nVERSION 0.7\nFIELDS x y z\nPOINTS 2\nDATA binary\n"
    (tmp_path / "a.pcd").write_bytes(head + struct.pack("<6f", 1, 2, 3, 4, 5, 6))
    assert [(r.pid, r.x) for r in readers.read_pcd(spark, str(tmp_path)).orderBy("pid").collect()] == [(0, 1.0), (1, 4.0)]


def test_image_decoder():
    assert readers.decode_image(bytes([255, 0, 0]), 1, 1, 3, "rgb8").tolist() == [[[0, 0, 255]]]
    with pytest.raises(ValueError, match="unsupported"):
        readers.decode_image(b"", 1, 1, 3, "yuv")


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿frame,valid\n1,True\n".encode())
    assert readers.read_text_csv(spark, str(tmp_path / "m.csv"), ["frame", "valid"]).collect() == [("1", "True")]
    (tmp_path / "log.jsonl").write_text('{"processed":true,"rgb_frame_id":1,"new_lidar_update":true,"latest_lidar_frame_id":7,"persons":[{"track_id":"T1","xyz_valid":true,"x":1.0,"y":2.0,"z":3.0},{"track_id":"T2","xyz_valid":false}]}\n{"processed":false,"rgb_frame_id":2}\n')
    log = readers.read_log(spark, str(tmp_path / "log.jsonl"))
    assert [tuple(r) for r in readers.predictions(log).collect()] == [(7, 0, "T1", 1.0, 2.0, 3.0)]
    readers.write_csv([spark.range(1).toDF("id"), spark.range(1).toDF("b")], str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["id", "b"]
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.resume(spark, str(tmp_path / "kept"), 3, make).count() == 3
    assert len(made) == 1


def test_profiles(tmp_path):
    p = tmp_path / "p.json"
    p.write_text('{"dataset": "scene28", "adapter_status": "ready", "scene_specific_priors": {"occupancy": true}}')
    with pytest.raises(ValueError, match="priors"):
        readers.load_profile(str(p), "scene28")
    with pytest.raises(ValueError, match="another"):
        readers.load_profile(str(p), "scene01")
