"""Causal acceptance of components that suppression removed, by the past motion of their track.

A decision is made in two steps: ``verdict`` looks, without changing anything, and names what it
found; ``CONSEQUENCE`` says for every name whether the component is taken and what becomes of
the track's run of seeds.  So the rules stand in one table and the memory changes in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import hypot, log
from typing import NamedTuple

import numpy as np

from fusegrid.functions import model as M
from fusegrid.streaming.states import motion_gate

#: fixed values: reason codes of components that are not fit to be compared, in order of precedence
UNFIT = ("NO_OCCUPANCY_DELETED_COMPONENT", "TOO_FEW_POINTS", "CENTER_OUTSIDE_ORIGINAL_BOX", "IMPLAUSIBLE_3D_SIZE", "COMPONENT_SCORE_ABOVE_EXISTING_ASSIGNMENT_LIMIT", "NEIGHBOR_PERSON_COMPETITION", "AMBIGUOUS_COMPONENT_RANKING")
#: fixed values: (component taken, run of seeds kept, grown or ended) by reason code
CONSEQUENCE = dict.fromkeys(UNFIT, (False, "ended")) | {
    "HISTORY_MOTION_COMPATIBLE": (True, "ended"),
    "HISTORY_MOTION_GATE_REJECT": (False, "kept"),
    "NORMAL_SIGNATURE_UNAVAILABLE": (False, "kept"),
    "HISTORY_COMPONENT_SIGNATURE_REJECT": (False, "kept"),
    "NO_METRIC_HISTORY": (False, "kept"),
    "CAUSAL_SEED_PENDING": (False, "grown"),
    "CAUSAL_SEED_CONFIRMED": (True, "ended"),
}


class Trail(NamedTuple):
    """Where a track was last, how it moves on the ground per frame, and its last ordinary shape."""

    xyz: np.ndarray
    velocity: np.ndarray
    frame: int
    shape: tuple | None

    def ahead(self, frame: int) -> np.ndarray:
        return self.xyz + self.velocity * (frame - self.frame)


class Seeds(NamedTuple):
    """Candidates in consecutive frames, each near the one before."""

    xyz: np.ndarray
    frame: int
    length: int


def apart(a, b) -> float:
    """Distance on the ground."""
    return hypot(a[0] - b[0], a[1] - b[1])


def shape_gaps(a: tuple, b: tuple) -> Iterator[float]:
    """Log ratios of both spans and the count, then differences of the relative centre."""
    for x, y in zip(a[:3], b[:3], strict=True):
        yield abs(log(max(float(x), 1e-6) / max(float(y), 1e-6)))
    for x, y in zip(a[3:5], b[3:5], strict=True):
        yield abs(x - y)


@dataclass
class Recovery:
    """Trails and runs of seeds of one scene.

    ``limits`` (distance, then those of ``shape_gaps``) make it strict; ``seeds_allowed`` lets a track
    without a trail begin one after ``seed_frames`` candidates in a run.
    """

    seeds_allowed: bool = False
    limits: tuple | None = None
    max_age: int = M.MAX_AGE_FRAMES
    seed_frames: int = 3
    trails: dict[str, Trail] = field(default_factory=dict)
    seeds: dict[str, Seeds] = field(default_factory=dict)

    def observe(self, track: str, xyz, frame: int, shape: tuple | None = None) -> None:
        """An ordinary measurement: it moves the trail and ends a run of seeds."""
        self._move(track, xyz, frame)
        self.trails[track] = self.trails[track]._replace(shape=shape)
        self.seeds.pop(track, None)

    def consider(self, track: str, candidate: dict | None, frame: int) -> tuple[bool, str]:
        """(accepted, reason)."""
        reason = self.verdict(track, candidate, frame)
        taken, run = CONSEQUENCE[reason]
        if run == "grown":
            self.seeds[track] = self._run(track, candidate["xyz"], frame)
        elif run == "ended":
            self.seeds.pop(track, None)
        if taken:
            self._move(track, candidate["xyz"], frame)
        return taken, reason

    def verdict(self, track: str, c: dict | None, frame: int) -> str:
        unfit = (True,) if c is None else (False, c["n"] < M.MIN_COMPONENT_POINTS, not c["inside"], not c["plausible"], c["score"] > M.ASSOCIATION_LIMIT, c["competition"], c["ambiguous"])
        if any(unfit):
            return UNFIT[unfit.index(True)]
        trail = self.trails.get(track)
        if trail is not None and trail.frame < frame <= trail.frame + self.max_age:
            return self._beside(trail, c, frame)
        if not self.seeds_allowed:
            return "NO_METRIC_HISTORY"
        return "CAUSAL_SEED_CONFIRMED" if self._run(track, c["xyz"], frame).length >= self.seed_frames else "CAUSAL_SEED_PENDING"

    def _beside(self, trail: Trail, c: dict, frame: int) -> str:
        """The verdict on a fit candidate of a track with a recent trail."""
        reach, shape = motion_gate(frame - trail.frame), c.get("signature")
        if self.limits is not None:
            reach = min(reach, self.limits[0])
            if shape is None or trail.shape is None:
                return "NORMAL_SIGNATURE_UNAVAILABLE"
            if any(gap > most for gap, most in zip(shape_gaps(shape, trail.shape), self.limits[1:], strict=True)):
                return "HISTORY_COMPONENT_SIGNATURE_REJECT"
        return "HISTORY_MOTION_COMPATIBLE" if apart(c["xyz"], trail.ahead(frame)) <= reach else "HISTORY_MOTION_GATE_REJECT"

    def _run(self, track: str, xyz, frame: int) -> Seeds:
        """The track's run of seeds with this candidate, which begins a new one unless it goes on from the frame before."""
        last = self.seeds.get(track)
        goes_on = last is not None and last.frame == frame - 1 and apart(xyz, last.xyz) <= motion_gate(1)
        return Seeds(np.asarray(xyz, float), frame, last.length + 1 if goes_on else 1)

    def _move(self, track: str, xyz, frame: int) -> None:
        here, old = np.asarray(xyz, float), self.trails.get(track)
        velocity, shape = np.zeros(3), None
        if old is not None:
            shape = old.shape
            if frame > old.frame:
                velocity = (M.EWMA_KEEP * old.velocity + M.EWMA_NEW * (here - old.xyz) / (frame - old.frame)) * (1, 1, 0)
        self.trails[track] = Trail(here, velocity, frame, shape)
