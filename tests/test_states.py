"""State machines: pinned sequences, and batch against stream."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusegrid.operators.assign import solve
from fusegrid.plans import queries_state as Q
from fusegrid.sources import relations as R
from fusegrid.streaming import folds
from fusegrid.streaming import queries as SQ
from fusegrid.streaming.identity import IdentityManager
from fusegrid.streaming.recovery import Recovery
from fusegrid.streaming.states import AnonymousTracker, MotionBank, ShortTermTracker, SlotSync

SF = "/root/testdata/sf0.001"
E1, E2 = [1.0, 0.0], [0.0, 1.0]


def seen(x, box=(10, 10, 30, 50)):
    return {"class": "PERSON", "bbox": box, "xyz": None if x is None else [x, 0.0, -1.0]}


def who(track, x, vector=None):
    return {"track_id": track, "xyz": None if x is None else [x, 0.0, -1.0], "vector": vector}


def test_solver_equals_permutations():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n, m = map(int, rng.integers(1, 6, 2))
        c = rng.integers(0, 9, (n, m)).astype(float)
        r, k = solve(c)
        small, big = (c, m) if n <= m else (c.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(big), len(small)))
        assert c[r, k].sum() == pytest.approx(best) and len(set(k.tolist())) == len(k) == min(n, m)


def test_tracker_keeps_ids_over_one_frame_and_not_over_eleven():
    t = ShortTermTracker()
    assert t.update([seen(1.0)])[0]["track_id"] == "T0001"
    t.update([])
    assert t.update([seen(1.1)])[0]["track_id"] == "T0001" and t.continuations == 1
    for _ in range(11):
        t.update([])
    assert t.update([seen(1.1)])[0]["track_id"] == "T0002" and t.deaths == 1


def test_tracker_matches_first_two_by_order():
    t = ShortTermTracker()
    t.update([seen(1.0), seen(4.0, (300, 10, 340, 90))])
    assert [r["track_id"] for r in t.update([seen(1.05), seen(4.05, (302, 10, 342, 90))])] == ["T0001", "T0002"]


def test_tracker_takes_persons_only():
    with pytest.raises(ValueError, match="persons"):
        ShortTermTracker().update([seen(1.0) | {"class": "ROBOT"}])


def test_motion_velocity_and_held_height():
    b = MotionBank()
    b.correct([{"track_id": "T1", "xyz": [1.0, 0.0, 0.8]}], 1_000_000_000)
    first = b.snapshot(1_000_000_000)["T1"]
    b.mark(["T1"])
    b.correct([{"track_id": "T1", "xyz": [1.1, 0.0, 0.8]}], 1_100_000_000)
    b.mark(["T1"])
    ahead = b.snapshot(1_150_000_000)["T1"]
    assert first["state_source"] == "LIDAR_MEASUREMENT" and ahead["state_source"] == "CAUSAL_PREDICTION"
    assert b.states["T1"].velocity[0] == pytest.approx(0.28) and ahead["xyz"][0] == pytest.approx(1.114) and ahead["xyz"][2] == 0.8


def test_motion_freshness_bound_and_order():
    b = MotionBank()
    b.correct([{"track_id": "T1", "xyz": [1.0, 0.0, 0.8]}], 1_000_000_000)
    assert b.snapshot(1_180_000_000)["T1"]["fresh"] and not b.snapshot(1_181_000_000)["T1"]["fresh"]
    assert b.snapshot(999_999_999) == {}
    with pytest.raises(ValueError):
        b.correct([], 1_000_000_000)


def test_emitted_snapshot_is_not_rewritten():
    b = MotionBank()
    b.correct([{"track_id": "T1", "xyz": [1.0, 0.0, 0.8]}], 1_000_000_000)
    shot = b.snapshot(1_033_000_000)["T1"]["xyz"].copy()
    kept = b.snapshot(1_033_000_000)["T1"]["xyz"]
    b.correct([{"track_id": "T1", "xyz": [8.0, 0.0, 0.8]}], 1_100_000_000)
    assert (kept == shot).all()


def candidate(**more):
    return {"xyz": [1.0, 0.0, 0.8], "n": 8, "score": 0.4, "inside": True, "plausible": True, "competition": False, "ambiguous": False, "signature": (0.5, 1.5, 20, 0.0, 0.0)} | more


def test_recovery_by_history_and_seeds():
    r = Recovery()
    assert r.consider("T1", candidate(), 5) == (False, "NO_METRIC_HISTORY")
    r.observe("T1", [1.0, 0.0, 0.8], 5)
    assert r.consider("T1", candidate(xyz=[1.1, 0.0, 0.8]), 6) == (True, "HISTORY_MOTION_COMPATIBLE")
    assert r.consider("T1", candidate(xyz=[9.0, 0.0, 0.8]), 7) == (False, "HISTORY_MOTION_GATE_REJECT")
    s = Recovery(seeds_allowed=True)
    assert [s.consider("T2", candidate(), f) for f in (1, 2, 3)] == [(False, "CAUSAL_SEED_PENDING")] * 2 + [(True, "CAUSAL_SEED_CONFIRMED")]


@pytest.mark.parametrize(("more", "reason"), [({"n": 2}, "TOO_FEW_POINTS"), ({"inside": False}, "CENTER_OUTSIDE_ORIGINAL_BOX"), ({"plausible": False}, "IMPLAUSIBLE_3D_SIZE"), ({"score": 1.2}, "COMPONENT_SCORE_ABOVE_EXISTING_ASSIGNMENT_LIMIT"), ({"competition": True}, "NEIGHBOR_PERSON_COMPETITION"), ({"ambiguous": True}, "AMBIGUOUS_COMPONENT_RANKING")])
def test_recovery_quality(more, reason):
    assert Recovery().consider("T1", candidate(**more), 1) == (False, reason)


def test_strict_recovery_wants_a_like_signature():
    r = Recovery(limits=(0.25, 0.2, 0.2, 0.3, 0.1, 0.1))
    r.observe("T1", [1.0, 0.0, 0.8], 1, (0.5, 1.5, 20, 0.0, 0.0))
    assert r.consider("T1", candidate(signature=(1.0, 1.5, 20, 0.0, 0.0)), 2)[1] == "HISTORY_COMPONENT_SIGNATURE_REJECT"
    assert r.consider("T1", candidate(signature=None), 2)[1] == "NORMAL_SIGNATURE_UNAVAILABLE"
    assert r.consider("T1", candidate(), 2) == (True, "HISTORY_MOTION_COMPATIBLE")


def manager():
    return IdentityManager({"G01": np.array(E1), "G02": np.array(E2)})


def test_identity_survives_one_bad_look_and_short_occlusion():
    m = manager()
    m.resolve([who("G01", 1.0, E1)], 1_000_000_000)
    assert m.resolve([who("G01", 1.05, E2)], 1_100_000_000)[0]["identity_source"] == "TRACK_INHERITANCE"
    m.resolve([], 1_200_000_000)
    back = m.resolve([who("G01", 1.1)], 1_300_000_000)[0]
    assert back["identity"] == "G01" and back["identity_source"] == "SHORT_OCCLUSION_HOLD"


def test_identity_recovers_by_motion_and_look_only():
    m = manager()
    m.resolve([who("G01", 1.0, E1)], 1_000_000_000)
    m.resolve([], 1_500_000_000)
    assert m.resolve([who("T0001", 1.2, E1)], 2_000_000_000)[0]["identity_source"] == "CAUSAL_RECOVERY"
    n = manager()
    n.resolve([who("G01", 1.0, E1)], 1_000_000_000)
    n.resolve([], 1_100_000_000)
    assert n.resolve([who("T0001", 8.0, E1)], 1_200_000_000)[0]["identity"] is None
    assert n.events[-1][4] == "RECOVERY_REJECTED_MOTION_INCOMPATIBLE"


def test_identity_is_given_once():
    m = manager()
    m.resolve([who("G01", 1.0, E1), who("G02", 4.0, E2)], 1_000_000_000)
    m.resolve([], 1_100_000_000)
    rows = m.resolve([who("T0001", 1.1, E1), who("T0002", 1.2, E1)], 1_200_000_000)
    assert [r["identity"] for r in rows if r["identity"]] == ["G01"]
    with pytest.raises(ValueError, match="causal"):
        m.resolve([], 1_200_000_000)


def test_anonymous_ids_by_overlap():
    t = AnonymousTracker()
    assert t.update([seen(None), seen(None, (300, 10, 340, 90))]) == ["A0001", "A0002"]
    assert t.update([seen(None, (302, 10, 342, 90))]) == ["A0002"]


def test_slot_sync_bounds():
    s = SlotSync()
    assert s.rgb(0, 64_000_000) is None and s.lidar(0, 100_000_000) is None
    assert s.rgb(1, 65_000_000) == (0, 1, 35_000_000)
    assert s.lidar(1, 200_000_000) is None and s.rgb(2, 230_000_000) is None and s.close() == 1


def streamed(spark, rows, run, tmp_path, cuts):
    """The same rows as files of parts of them, by conditions in order, a file a batch, through the streaming fold; then each scene's end."""
    folder = tmp_path / "in"
    unit = next(c for c in ("frame", "arrival_ns", "ts_ns") if c in rows.columns)
    last = rows.dropDuplicates(["scene"]).withColumn(unit, F.lit(folds.END))
    for i, part in enumerate([*(rows.where(c) for c in cuts), last]):
        part.coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*"):
            if not f.name.startswith("part-cut"):
                f.rename(folder / f"part-cut{i:03d}.parquet")
    stream = SQ.read_parquet_stream(spark, str(folder), rows.schema, 1)
    return SQ.run_once(run(stream), str(tmp_path / "out"), str(tmp_path / "check"))


def same(a, b):
    got = sorted(map(tuple, a.collect()), key=str)
    assert got and got == sorted(map(tuple, b.collect()), key=str)


#: two cuts between frames, and one inside frame 9
CUTS = ["frame < 3", "frame between 3 and 8", "frame = 9 and det < 2", "frame = 9 and det >= 2 or frame > 9"]


def test_tracks_by_stream_equal_batch(spark, tmp_path):
    rows = Q._scenes(spark, SF)
    same(streamed(spark, rows, folds.track, tmp_path, CUTS), folds.track(rows))


def test_anonymous_by_stream_equal_batch(spark, tmp_path):
    rows = Q._scenes(spark, SF)
    same(streamed(spark, rows, folds.anonymous, tmp_path, CUTS), folds.anonymous(rows))


def test_sync_by_stream_equals_batch(spark, tmp_path):
    rows = Q.sync_events(spark, SF)
    a, b = rows.selectExpr("percentile(arrival_ns, array(.3, .6))").first()[0]
    run = lambda e: folds.slot_sync(e, 1_800_000_000)
    same(streamed(spark, rows, run, tmp_path, [f"arrival_ns < {int(a)}", f"arrival_ns >= {int(a)} and arrival_ns < {int(b)}", f"arrival_ns >= {int(b)}"]), run(rows))


def test_recovery_by_stream_equals_batch(spark, tmp_path):
    rows = Q._candidates(spark, SF)
    same(streamed(spark, rows, folds.recovery, tmp_path, ["frame < 4", "frame = 4 and track_id < '2'", "frame = 4 and track_id >= '2' or frame > 4"]), folds.recovery(rows))


def test_motion_by_stream_equals_batch(spark, tmp_path):
    rows = Q._motions(spark, SF)
    same(streamed(spark, rows, folds.motion, tmp_path, ["ts_ns < 500000000", "ts_ns = 500000000 and track_id < 'T0002'", "ts_ns = 500000000 and track_id >= 'T0002' or ts_ns > 500000000"]), folds.motion(rows))


def test_identities_by_stream_equal_batch(spark, tmp_path):
    rows, run = Q._people(spark, SF), lambda r: folds.identities(r, Q.KNOWN)
    same(streamed(spark, rows, run, tmp_path, ["ts_ns < 900000001", "ts_ns = 900000001 and track_id < 'G02'", "ts_ns = 900000001 and track_id >= 'G02' or ts_ns > 900000001"]), run(rows))


def test_late_rows_of_a_stream_raise(spark, tmp_path):
    rows = Q._scenes(spark, SF)
    with pytest.raises(Exception, match="after it was emitted"):
        streamed(spark, rows, folds.track, tmp_path, ["frame > 5", "frame <= 5"]).collect()


def test_asof_stream_finds_the_latest_past(spark, tmp_path):
    schema = "idx long, ts timestamp, ts_ns long"
    at = lambda ms: f"timestamp_micros({ms}000)"
    rgb = spark.sql(" union all ".join(f"select {i}L idx, {at(ms)} ts, {ms}000000L ts_ns" for i, ms in enumerate((10, 40, 80, 105, 500))))
    lidar = spark.sql(" union all ".join(f"select {i}L idx, {at(ms)} ts, {ms}000000L ts_ns" for i, ms in enumerate((100, 141, 400))))
    for name, d in (("rgb", rgb), ("lidar", lidar)):
        d.coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda n: SQ.read_parquet_stream(spark, str(tmp_path / n), schema)
    q = SQ.asof_stream(read("lidar"), read("rgb")).writeStream.format("memory").queryName("asof").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("asof").where("lidar_idx = 0").select("rgb_idx", "age_ns").collect() == [(2, 20_000_000)]
    assert R.table(spark, SF, "events").count()
