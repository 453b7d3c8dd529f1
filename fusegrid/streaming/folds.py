"""State machines over rows of a scene: a batch fold, or a streaming query with the same steps.

The key is the unit of parallelism.  A step gets whole units (frames, or times) of a key in
order and the state so far.  A stream holds the rows of a key's latest unit until a later one
begins, as the next batch may bring more of it; a row of the unit END ends what is held.
So a batch fold and a stream over any cut of the rows, inside units too, give the
same rows; nothing already emitted is written again, and a row of a unit that has been
emitted raises.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fusegrid.streaming import states as S
from fusegrid.streaming.identity import IdentityManager
from fusegrid.streaming.recovery import Recovery

Step = Callable[[object, pd.DataFrame], pd.DataFrame]
#: The unit of a row that only says that its key's rows have ended.
END = (1 << 63) - 1


def fold(rows: DataFrame, key: str, order: Sequence[str], schema: str, new: Callable[[], object], step: Step) -> DataFrame:
    """The step over each key's rows; batch or streaming by what ``rows`` is."""

    unit = order[0]

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        return step(new(), part[part[unit] < END].sort_values(list(order), kind="stable"))

    if not rows.isStreaming:
        return rows.groupBy(key).applyInPandas(whole, schema)

    def partly(_, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting, done = pickle.loads(held.get[0]) if held.exists else (new(), None, None)
        part = pd.concat([p for p in (waiting, *parts) if p is not None], ignore_index=True)
        real = part[part[unit] < END].sort_values(list(order), kind="stable")
        if done is not None and len(real) and real[unit].iloc[0] <= done:
            raise ValueError(f"a row of {unit} {real[unit].iloc[0]} came after it was emitted")
        ready = real if len(real) < len(part) else real[real[unit] < real[unit].iloc[-1]]
        out = step(state, ready) if len(ready) else None
        done = ready[unit].iloc[-1] if len(ready) else done
        held.update((pickle.dumps((state, real.iloc[len(ready) :], done)),))
        if out is not None:
            yield out

    return rows.groupBy(key).applyInPandasWithState(partly, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def _xyz(r) -> np.ndarray | None:
    return None if pd.isna(r.x) else np.array([r.x, r.y, r.z], float)


TRACKS = "scene long, frame long, det int, track_id string, track_age int, vx double, vy double"


def track(rows: DataFrame) -> DataFrame:
    """Short-term tracks of detections (scene, frame, det, x, y, z or null, x1, y1, x2, y2); missing frames are empty frames."""

    def step(t: S.ShortTermTracker, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for frame, f in part.groupby("frame", sort=True):
            while t.frame + 1 < frame and t.frame >= 0:
                t.update([])
            if t.frame < 0:
                t.frame = int(frame) - 1
            f = f.sort_values("det")
            for r, d in zip(f.itertuples(), t.update([{"xyz": _xyz(r), "bbox": (r.x1, r.y1, r.x2, r.y2)} for r in f.itertuples()]), strict=True):
                v = t.tracks[d["track_id"]].velocity
                out.append((r.scene, frame, r.det, d["track_id"], d["track_age"], float(v[0]), float(v[1])))
        return pd.DataFrame(out, columns=["scene", "frame", "det", "track_id", "track_age", "vx", "vy"])

    return fold(rows, "scene", ["frame", "det"], TRACKS, S.ShortTermTracker, step)


def track_statistics(rows: DataFrame) -> DataFrame:
    """Births, deaths, matches, continuations and lifetimes of each scene's tracks (batch)."""
    columns = ["active", "births", "deaths", "matches", "continuations", "mean_lifetime", "max_lifetime"]

    def step(t: S.ShortTermTracker, part: pd.DataFrame) -> pd.DataFrame:
        t.frame = int(part.frame.min()) - 1
        for frame, f in part.groupby("frame", sort=True):
            while t.frame + 1 < frame:
                t.update([])
            t.update([{"xyz": _xyz(r), "bbox": (r.x1, r.y1, r.x2, r.y2)} for r in f.sort_values("det").itertuples()])
        s = t.statistics()
        return pd.DataFrame([[part.scene.iloc[0], *[s[c] for c in columns]]], columns=["scene", *columns])

    return fold(rows, "scene", ["frame", "det"], "scene long, active int, births int, deaths int, matches int, continuations int, mean_lifetime double, max_lifetime int", S.ShortTermTracker, step)


def anonymous(rows: DataFrame) -> DataFrame:
    """Ids of boxes without positions (scene, frame, det, cls, x1, y1, x2, y2)."""

    def step(t: S.AnonymousTracker, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for frame, f in part.groupby("frame", sort=True):
            f = f.sort_values("det")
            ids = t.update([{"class": r.cls, "bbox": (r.x1, r.y1, r.x2, r.y2)} for r in f.itertuples()])
            out += [(r.scene, frame, r.det, i) for r, i in zip(f.itertuples(), ids, strict=True)]
        return pd.DataFrame(out, columns=["scene", "frame", "det", "anonymous_id"])

    return fold(rows, "scene", ["frame", "det"], "scene long, frame long, det int, anonymous_id string", S.AnonymousTracker, step)


SYNC = "scene long, lidar_idx long, rgb_idx long, age_ns long"


def slot_sync(events: DataFrame, slop_ns: int = 35_000_000) -> DataFrame:
    """Pairs of the runtime's one-slot synchronisation of events (scene, arrival_ns, topic, idx, ts_ns) in arrival order."""

    def step(s: S.SlotSync, part: pd.DataFrame) -> pd.DataFrame:
        hits = [(r.scene, (s.lidar if r.topic == "lidar" else s.rgb)(int(r.idx), int(r.ts_ns))) for r in part.itertuples()]
        return pd.DataFrame([(scene, *h) for scene, h in hits if h is not None], columns=["scene", "lidar_idx", "rgb_idx", "age_ns"])

    return fold(events, "scene", ["arrival_ns", "topic", "idx"], SYNC, lambda: S.SlotSync(slop_ns), step)


MOTION = "scene long, ts_ns long, track_id string, x double, y double, fresh boolean, state_source string, horizon_ms double"


def motion(events: DataFrame) -> DataFrame:
    """Snapshots of all tracks at each image event, and corrections at each measurement.

    events: scene, ts_ns, kind (0 image, 1 measurement: an image comes first at equal times, so that a measurement is
    first reported by a later image), track_id, x, y, z.  Fresh tracks are reported.
    """

    def step(b: S.MotionBank, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (ns, kind), f in part.groupby(["ts_ns", "kind"], sort=True):
            if kind == 1:
                b.correct([{"track_id": r.track_id, "xyz": _xyz(r)} for r in f.itertuples()], int(ns))
                continue
            shot = b.snapshot(int(ns))
            out += [(f.scene.iloc[0], ns, k, v["xyz"][0], v["xyz"][1], v["fresh"], v["state_source"], v["horizon_ms"]) for k, v in sorted(shot.items())]
            b.mark([k for k, v in shot.items() if v["fresh"]])
        return pd.DataFrame(out, columns=["scene", "ts_ns", "track_id", "x", "y", "fresh", "state_source", "horizon_ms"])

    return fold(events, "scene", ["ts_ns", "kind", "track_id"], MOTION, S.MotionBank, step)


DECISIONS = "scene long, frame long, track_id string, accepted boolean, reason string"


def shape_of(r) -> tuple | None:
    """Spans, count and relative centre of a row that has them."""
    if not hasattr(r, "hspan") or pd.isna(r.hspan):
        return None
    return float(r.hspan), float(r.vspan), float(r.n), float(r.cu), float(r.cv)


def candidate_of(r) -> dict:
    return {"xyz": _xyz(r), "n": r.n, "score": r.score, "inside": r.inside, "plausible": r.plausible, "competition": r.competition, "ambiguous": r.ambiguous, "signature": shape_of(r)}


def recovery(rows: DataFrame, seeds_allowed: bool = False, limits: tuple | None = None) -> DataFrame:
    """Decisions on candidates (scene, frame, track_id, normal, x, y, z, n, score, inside, plausible, competition, ambiguous).

    ``limits`` (see ``thresholds.limits_of``) make them strict; rows then also have hspan, vspan, cu and cv.
    """

    def step(s: Recovery, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in part.itertuples():
            if r.normal:
                s.observe(r.track_id, _xyz(r), int(r.frame), shape_of(r))
                continue
            out.append((r.scene, r.frame, r.track_id, *s.consider(r.track_id, candidate_of(r), int(r.frame))))
        return pd.DataFrame(out, columns=["scene", "frame", "track_id", "accepted", "reason"])

    return fold(rows, "scene", ["frame", "track_id"], DECISIONS, lambda: Recovery(seeds_allowed, limits), step)


def identities(rows: DataFrame, prototypes: dict[str, list[float]]) -> DataFrame:
    """Persistent identities of tracks (scene, ts_ns, track_id, x, y, z, vector)."""
    known = {k: np.asarray(v, float) for k, v in prototypes.items()}

    def step(m: IdentityManager, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ns, f in part.groupby("ts_ns", sort=True):
            people = [{"track_id": r.track_id, "xyz": _xyz(r), "vector": r.vector} for r in f.itertuples()]
            for r, p in zip(f.itertuples(), m.resolve(people, int(ns)), strict=True):
                out.append((r.scene, ns, r.track_id, p["identity"], p["identity_state"], p["identity_source"]))
        return pd.DataFrame(out, columns=["scene", "ts_ns", "track_id", "identity", "identity_state", "identity_source"])

    schema = "scene long, ts_ns long, track_id string, identity string, identity_state string, identity_source string"
    return fold(rows, "scene", ["ts_ns", "track_id"], schema, lambda: IdentityManager(known), step)
