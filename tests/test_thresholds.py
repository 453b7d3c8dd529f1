"""Frozen limits of ordinary change, and strict decisions under them by batch and by stream."""

import random
from math import hypot, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusegrid.plans import queries_state as Q
from fusegrid.streaming import folds, thresholds
from fusegrid.streaming import queries as SQ

SF = "/root/testdata/sf0.001"
SHAPED = "scene long, frame long, track_id string, normal boolean, x double, y double, z double, n long, score double, inside boolean, plausible boolean, competition boolean, ambiguous boolean, hspan double, vspan double, cu double, cv double"


def walks(spark, frames=60):
    rng, rows = random.Random(8), []
    for scene in range(2):
        for track in ("T0001", "T0002", "T0003"):
            x, y = rng.uniform(1, 8), rng.uniform(-2, 2)
            for f in range(frames):
                x, y = x + rng.uniform(-0.1, 0.12), y + rng.uniform(-0.05, 0.05)
                if rng.random() < 0.2 or 20 <= f < 32 and track == "T0003":
                    continue  # T0003 is away for longer than a track lives
                wild = rng.random() < 0.3
                shape = (0.5 * rng.uniform(0.9, 1.1) * (3 if wild else 1), 1.7 * rng.uniform(0.95, 1.05), rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1))
                rows.append((scene, f, track, rng.random() < 0.7, x, y, -1.0, rng.randint(3, 30), 0.3, True, True, False, rng.random() < 0.1, *shape))
    return spark.createDataFrame(rows, SHAPED)


def brute_changes(rows):
    last, out = {}, []
    for r in sorted(rows, key=lambda r: (r.scene, r.frame, r.track_id)):
        k = (r.scene, r.track_id)
        v = (0.0, 0.0)
        if k in last:
            o, w = last[k]
            gap = r.frame - o.frame
            if gap <= 10:
                out.append((r.scene, r.frame, r.track_id, hypot(r.x - o.x - w[0] * gap, r.y - o.y - w[1] * gap), abs(log(r.hspan / o.hspan)), abs(log(r.vspan / o.vspan)), abs(log(r.n / o.n)), abs(r.cu - o.cu), abs(r.cv - o.cv)))
                v = (0.72 * w[0] + 0.28 * (r.x - o.x) / gap, 0.72 * w[1] + 0.28 * (r.y - o.y) / gap)
        last[k] = (r, v)
    return sorted(out)


def test_changes_and_their_limits_equal_brute_force(spark):
    rows = walks(spark).where("normal")
    want = brute_changes(rows.collect())
    got = sorted(map(tuple, thresholds.changes(rows).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want])
    held = {r.measure: (r.n, r.limit) for r in thresholds.frozen(thresholds.changes(rows), "frame < 30", 20).collect()}
    for i, m in enumerate(thresholds.MEASURES):
        v = np.array([w[3 + i] for w in want if w[1] < 30])
        mid = np.median(v)
        limit = min(np.quantile(v, 0.99), max(mid + 3 * 1.4826 * np.median(np.abs(v - mid)), np.quantile(v, 0.9)))
        assert held[m] == (len(v), pytest.approx(min(limit, 1.2) if i == 0 else limit))
    assert thresholds.limits_of(thresholds.frozen(thresholds.changes(rows), "frame < 30", 20)) == tuple(held[m][1] for m in thresholds.MEASURES)


def test_too_few_changes_freeze_nothing(spark):
    few = thresholds.frozen(thresholds.changes(walks(spark).where("normal")), "frame < 3", 100)
    with pytest.raises(ValueError, match="innovation"):
        thresholds.limits_of(few)
    assert thresholds.changes(walks(spark).where("frame < 0")).collect() == []


def test_strict_decisions_by_stream_equal_batch(spark, tmp_path):
    rows = walks(spark)
    frozen = thresholds.frozen(thresholds.changes(rows.where("normal")), "frame < 30", 20)
    limits = thresholds.limits_of(frozen)
    want = sorted(map(tuple, folds.recovery(rows, limits=limits).collect()))
    reasons = {r[4] for r in want}
    assert {"HISTORY_COMPONENT_SIGNATURE_REJECT", "HISTORY_MOTION_COMPATIBLE", "NO_METRIC_HISTORY", "AMBIGUOUS_COMPONENT_RANKING"} <= reasons
    loose = sorted(map(tuple, folds.recovery(rows).collect()))
    assert sum(r[3] for r in loose) > sum(r[3] for r in want) > 0
    folder = tmp_path / "in"
    for i, part in enumerate(("frame < 17", "frame = 17", "frame between 18 and 40", "frame > 40")):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*"):
            if not f.name.startswith("part-cut"):
                f.rename(folder / f"part-cut{i:03d}.parquet")
    with SQ.with_rocksdb(spark):
        stream = thresholds.strict_stream(SQ.read_parquet_stream(spark, str(folder), rows.schema, 1), thresholds.of_scenes(frozen, rows))
        got = SQ.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(map(tuple, got.collect())) == want


def test_query_is_strict(spark):
    rows = Q._shaped(spark, SF)
    got = {(r.scene, r.frame, r.track_id): r.accepted for r in Q.strict_recovery_decisions(spark, SF).collect()}
    loose = {(r.scene, r.frame, r.track_id): r.accepted for r in folds.recovery(rows).collect()}
    assert got.keys() == loose.keys() and rows.where(~F.col("normal")).count() == len(got)
    assert all(loose[k] for k, ok in got.items() if ok)
