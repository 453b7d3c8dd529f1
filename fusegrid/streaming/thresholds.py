"""Limits of ordinary change, learnt on the training split and handed to strict recovery.

A track's ordinary measurements change little from one to the next: in place against the motion so far
(the innovation), and in shape (two spans, the number of points, the relative centre).  The fold gives those
changes; their robust limits are frozen by selection over ranges of values, a row a measure.  A stream of
decisions takes the frozen limits of its scene as the initial state of its operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import hypot

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fusegrid.functions import model as M
from fusegrid.operators.aggregates import robust_limit
from fusegrid.streaming.folds import DECISIONS, candidate_of, fold, shape_of
from fusegrid.streaming.recovery import Recovery, Seeds, Trail, shape_gaps

#: In the order of ``Recovery.limits``.
MEASURES = ("innovation", "horizontal_log_ratio", "vertical_log_ratio", "count_log_ratio", "center_u", "center_v")
#: fixed value: no innovation limit is wider (m)
WIDEST_M = 1.2
CHANGES = "scene long, frame long, track_id string, " + ", ".join(f"{m} double" for m in MEASURES)


def changes(rows: DataFrame, max_age: int = M.MAX_AGE_FRAMES) -> DataFrame:
    """The changes of each ordinary measurement (scene, frame, track_id, x, y, z, hspan, vspan, n, cu, cv) since its track's last one; none over more than ``max_age`` frames."""

    def step(last: dict, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in part.itertuples():
            here, shape, velocity = (r.x, r.y), shape_of(r), (0.0, 0.0)
            if (old := last.get(r.track_id)) is not None and 0 < (gap := r.frame - old[3]) <= max_age:
                was, moved, before, _ = old
                out.append((r.scene, r.frame, r.track_id, hypot(*(a - b - v * gap for a, b, v in zip(here, was, moved, strict=True))), *shape_gaps(shape, before)))
                velocity = tuple(M.EWMA_KEEP * v + M.EWMA_NEW * (a - b) / gap for a, b, v in zip(here, was, moved, strict=True))
            last[r.track_id] = (here, velocity, shape, r.frame)
        for k in [k for k, v in last.items() if len(part) and part.frame.iloc[-1] - v[3] > max_age]:
            del last[k]  # too old to be compared with
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    return fold(rows, "scene", ["frame", "track_id"], CHANGES, dict, step)


def frozen(changed: DataFrame, until: str, least: int = 100) -> DataFrame:
    """(measure, n, limit) over the changes for which ``until`` holds; measures with fewer than ``least`` have no row."""
    long = changed.where(until).unpivot(["scene"], list(MEASURES), "measure", "value")
    g = robust_limit(long, "value", ["measure"], least)
    widest = F.when(F.col("measure") == MEASURES[0], F.least("limit", F.lit(WIDEST_M))).otherwise(F.col("limit"))
    return g.select("measure", "n", widest.alias("limit"))


def limits_of(limits: DataFrame) -> tuple[float, ...]:
    """The limits in the order that ``Recovery`` takes; raises unless all six are there."""
    held = {r.measure: r.limit for r in limits.collect()}  # a row a measure
    if missing := [m for m in MEASURES if m not in held]:
        raise ValueError(f"too few ordinary changes to freeze limits of {missing}")
    return tuple(held[m] for m in MEASURES)


class StrictRecovery(StatefulProcessor):
    """Decisions of a scene under the limits of its initial state; without them no candidate is accepted for its shape."""

    def __init__(self, seeds_allowed: bool):
        self.seeds_allowed = seeds_allowed

    def init(self, handle) -> None:
        self.limits = handle.getValueState("limits", ", ".join(f"{m} double" for m in MEASURES))
        self.trails = handle.getMapState("trails", "track_id string", "xyz array<double>, velocity array<double>, frame long, shape array<double>")
        self.seeds = handle.getMapState("seeds", "track_id string", "xyz array<double>, frame long, length long")

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.limits.update(tuple(float(initial[m].iloc[0]) for m in MEASURES))

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        if not self.limits.exists():
            raise ValueError(f"scene {key[0]} has no frozen limits")
        trails = {k[0]: Trail(np.array(v[0]), np.array(v[1]), v[2], None if v[3] is None else tuple(v[3])) for k, v in self.trails.iterator()}
        seeds = {k[0]: Seeds(np.array(v[0]), v[1], v[2]) for k, v in self.seeds.iterator()}
        memory = Recovery(self.seeds_allowed, tuple(self.limits.get()), trails=dict(trails), seeds=dict(seeds))
        part = pd.concat(list(rows), ignore_index=True).sort_values(["frame", "track_id"], kind="stable")
        out = decide(memory, part)
        for k, t in memory.trails.items():
            if trails.get(k) is not t:
                self.trails.updateValue((k,), (list(map(float, t.xyz)), list(map(float, t.velocity)), int(t.frame), None if t.shape is None else list(map(float, t.shape))))
        for k in seeds.keys() - memory.seeds.keys():
            self.seeds.removeKey((k,))
        for k, s in memory.seeds.items():
            if seeds.get(k) is not s:
                self.seeds.updateValue((k,), (list(map(float, s.xyz)), int(s.frame), int(s.length)))
        if len(out):
            yield out

    def close(self) -> None:
        pass


def decide(memory: Recovery, part: pd.DataFrame) -> pd.DataFrame:
    """Decisions on the candidates among rows in order; ordinary rows move the memory."""
    out = []
    for r in part.itertuples():
        if r.normal:
            memory.observe(r.track_id, (r.x, r.y, r.z), int(r.frame), shape_of(r))
        else:
            out.append((r.scene, r.frame, r.track_id, *memory.consider(r.track_id, candidate_of(r), int(r.frame))))
    return pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])


def strict_stream(rows: DataFrame, limits: DataFrame, seeds_allowed: bool = False) -> DataFrame:
    """Strict decisions over a stream of candidates and ordinary rows that come in order; ``limits`` has a row a scene (scene and MEASURES)."""
    initial = limits.select("scene", *MEASURES).groupBy("scene")
    return rows.groupBy("scene").transformWithStateInPandas(StrictRecovery(seeds_allowed), DECISIONS, "append", "none", initial)


def of_scenes(limits: DataFrame, scenes: DataFrame) -> DataFrame:
    """The frozen limits once for each scene, as ``strict_stream`` takes them."""
    one = limits.groupBy().pivot("measure", list(MEASURES)).agg(F.first("limit"))
    return scenes.select("scene").distinct().crossJoin(F.broadcast(one))
