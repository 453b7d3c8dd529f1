"""The online path of a scene: scans are tracked and correct the motions, images are associated with them.

One operator, keyed by scene, takes scans and images in the order of their times.  A scan's detections get
tracks (class by class; people may take an identity that nobody has, the best robot is R1), suppressed components may
stand in for missing positions, and what has a position corrects the motion of its track.  An image's
detections are matched with the fresh motions, projected ahead to its time; what is left over gets an anonymous id by overlap.

The state is a few small maps of one row a live track, so a stream keeps them as typed map state, of which a
batch of rows rewrites only the entries that changed; entries that can no longer matter are
dropped.  A batch runs the same steps over rows sorted within partitions, and holds one unit at a time.

Variants of a scene, as under several background policies, with and without recovery, are states of their own beside one
another: rows carry the name of their variant, the key is (scene, variant), and ``fan_out`` gives a
shared row to several variants.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, groupby
from math import hypot, isnan
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fusegrid.functions import model as M
from fusegrid.streaming.folds import END
from fusegrid.streaming.recovery import Recovery, Seeds, Trail
from fusegrid.streaming.states import INFEASIBLE, accepted, motion_gate, overlap

IMAGE, SCAN, LATE = 0, 1, 2
#: A unit's rows: kind 0 image, 1 scan; det -1 says that a unit has no other row.  Positions, looks and candidates are those of scans.
SIGHTING = "scene long, ns long, kind int, det int, cls string, conf double, x1 double, y1 double, x2 double, y2 double, x double, y double, z double, vector array<double>, rn double, rx double, ry double, rz double, rscore double, rinside boolean, rplausible boolean, rcompetition boolean, rambiguous boolean, variant string"
COLUMNS = tuple(c.split()[0] for c in SIGHTING.split(", "))
COUNTS = ("detections", "measurements", "person_measurements", "robot_measurements", "recovery_attempts", "recovery_accepted", "recovery_rejected", "late")
#: A row for each detection, and with det -1 one for each scan that has the counters, and one for late rows of a batch of a stream.
ONLINE = "scene long, ns long, kind int, det int, track_id string, cls string, x double, y double, z double, vx double, vy double, fresh boolean, state_source string, state_status string, horizon_ms double, measurement_source string, identity string, " + ", ".join(f"{c} int" for c in COUNTS) + ", variant string"
_OUT = tuple(c.split()[0] for c in ONLINE.split(", "))
#: How long a motion that is not measured again is kept; a fresh one is far younger.
MOTION_TTL_NS = 10_000_000_000
ROBOT = "R1"


class Seen(NamedTuple):
    det: int
    cls: str
    conf: float
    bbox: tuple
    xyz: tuple | None
    vector: tuple | None
    candidate: dict | None


class Track(NamedTuple):
    cls: str
    bbox: tuple
    xyz: tuple | None
    velocity: tuple
    last: int
    birth: int


class Motion(NamedTuple):
    cls: str
    xyz: tuple
    velocity: tuple
    ns: int
    reported: int
    bbox: tuple
    conf: float
    source: str
    age: int


class Box(NamedTuple):
    cls: str
    bbox: tuple
    image: int


class Clock(NamedTuple):
    scan: int = -1
    image: int = -1
    next_track: int = 1
    next_box: int = 1
    scan_ns: int = -1
    done_ns: int = -1
    done_kind: int = -1


def pixel(x: float, y: float, z: float, shift: str = "inference") -> tuple[float, float] | None:
    """The same projection as ``geometry.with_projection``, for the few points of one image's motions."""
    cx, cy, cz = (r[0] * x + r[1] * y + r[2] * z + r[3] for r in M.OPTICAL_FROM_ANNOTATED[:3].tolist())
    if cz <= 1e-8:
        return None
    (k1, k2, p1, p2, k3), (du, dv) = M.DISTORTION, M.SHIFTS[shift]
    a, b = cx / cz, cy / cz
    r2 = a * a + b * b
    radial = 1.0 + r2 * k1 + r2 * r2 * k2 + r2 * r2 * r2 * k3
    return (a * radial + a * b * (2 * p1) + (r2 + 2 * a * a) * p2) * M.FX + M.CX + du, (b * radial + (r2 + 2 * b * b) * p1 + a * b * (2 * p2)) * M.FY + M.CY + dv


def box_cost(p: tuple[float, float], b: Sequence[float]) -> float:
    w, h = max(b[2] - b[0], 1.0), max(b[3] - b[1], 1.0)
    outside = hypot(max(b[0] - p[0], 0.0, p[0] - b[2]) / w, max(b[1] - p[1], 0.0, p[1] - b[3]) / h)
    return 0.7 * outside + 0.3 * hypot((p[0] - (b[0] + b[2]) / 2) / w, (p[1] - (b[1] + b[3]) / 2) / h)


def likeness(t: Track, s: Seen, scan: int) -> float:
    """The cost of giving a sighting to a track."""
    if t.cls != s.cls:
        return INFEASIBLE
    o = overlap(t.bbox, s.bbox)
    if s.xyz is None or t.xyz is None:
        return 0.7 + 0.3 * (1 - o) if o >= 0.1 else INFEASIBLE
    gap = max(scan - t.last, 1)
    distance, gate = hypot(*(a - p - v * gap for a, p, v in zip(s.xyz[:2], t.xyz, t.velocity, strict=False))), motion_gate(gap)
    return 0.75 * distance / gate + 0.25 * (1 - o) if distance <= gate else INFEASIBLE


@dataclass
class Path:
    """The state of one scene, and its steps.

    ``prototypes`` (name: vector) makes the tracks identity-aware; without them all sightings must be people, tracks keep
    no vertical velocity, and an image reports only what has a fresh position.
    """

    prototypes: dict[str, tuple] | None = None
    recover: bool = False
    max_age: int = M.MAX_AGE_FRAMES
    clock: Clock = Clock()
    tracks: dict[str, Track] = field(default_factory=dict)
    motions: dict[str, Motion] = field(default_factory=dict)
    boxes: dict[str, Box] = field(default_factory=dict)
    trails: dict[str, Trail] = field(default_factory=dict)
    seeds: dict[str, Seeds] = field(default_factory=dict)

    # scans

    def scan(self, ns: int, seen: list[Seen]) -> list[dict]:
        if ns <= self.clock.scan_ns:
            raise ValueError("scans must come at strictly increasing times")
        if self.prototypes is None and any(s.cls != "PERSON" for s in seen):
            raise ValueError("without prototypes the path takes persons only")
        self.clock = self.clock._replace(scan=self.clock.scan + 1, scan_ns=ns)
        names = self._names(seen)
        positions, sources = [], []
        for name, s in zip(names, seen, strict=True):
            self.tracks[name] = self._moved(self.tracks.get(name), s)
        tried = {"attempts": 0, "accepted": 0}
        memory = Recovery(trails=self.trails, seeds=self.seeds, max_age=self.max_age)
        for name, s in zip(names, seen, strict=True):
            xyz, source = self._position(memory, name, s, tried)
            positions.append(xyz)
            sources.append(source)
        self._correct(ns, names, seen, positions, sources)
        self._forget(ns)
        of = lambda cls: sum(p is not None and s.cls == cls for p, s in zip(positions, seen, strict=True))
        counts = (len(seen), sum(p is not None for p in positions), of("PERSON"), of("ROBOT"), tried["attempts"], tried["accepted"], tried["attempts"] - tried["accepted"])
        rows = [{"ns": ns, "kind": SCAN, "det": -1} | dict(zip(COUNTS, counts, strict=False))]
        for name, s, xyz, source in zip(names, seen, positions, sources, strict=True):
            v = self.tracks[name].velocity
            rows.append({"ns": ns, "kind": SCAN, "det": s.det, "track_id": name, "cls": s.cls, "vx": v[0], "vy": v[1], "measurement_source": source, "identity": self._identity(name)} | _place(xyz))
        return rows

    def _identity(self, name: str) -> str | None:
        return name if self.prototypes is not None and (name in self.prototypes or name == ROBOT) else None

    def _names(self, seen: list[Seen]) -> list[str]:
        """The track of each sighting: the best match with live tracks, then unused identities, R1 and new names."""
        live = sorted(self.tracks)
        named: dict[int, str] = {}
        if live and seen:
            for r, c in accepted(np.array([[likeness(self.tracks[k], s, self.clock.scan) for s in seen] for k in live]), 1.0):
                named[c] = live[r]
        if self.prototypes is not None:
            self._take_identities(seen, named)
            robots = [i for i, s in enumerate(seen) if s.cls == "ROBOT"]
            if robots and ROBOT not in named.values():
                named[max(robots, key=lambda i: seen[i].conf)] = ROBOT
        for i in range(len(seen)):
            if i not in named:
                named[i] = f"T{self.clock.next_track:04d}"
                self.clock = self.clock._replace(next_track=self.clock.next_track + 1)
        return [named[i] for i in range(len(seen))]

    def _take_identities(self, seen: list[Seen], named: dict[int, str]) -> None:
        """People without a track, then those of a temporary one, take identities without a track that they look like; a temporary track goes on under it."""
        free = [n for n in sorted(self.prototypes) if n not in self.tracks]
        people = [i for i, s in enumerate(seen) if s.cls == "PERSON"]
        asking = [i for i in people if i not in named] + [i for i in people if named.get(i, "").startswith("T")]
        if not free or not asking:
            return
        like = lambda s, n: 0.0 if s.vector is None else float(np.dot(s.vector, self.prototypes[n]))
        for r, c in accepted(np.array([[1.0 - like(seen[i], n) for n in free] for i in asking]), M.APPEARANCE_LIMIT):
            before = named.get(asking[r])
            if before is not None:
                self.tracks[free[c]] = self.tracks.pop(before)
            named[asking[r]] = free[c]

    def _moved(self, old: Track | None, s: Seen) -> Track:
        velocity = (0.0, 0.0, 0.0) if old is None else old.velocity
        if old is not None and s.xyz is not None and old.xyz is not None:
            gap = max(self.clock.scan - old.last, 1)
            velocity = tuple(M.EWMA_KEEP * v + M.EWMA_NEW * (a - b) / gap for v, a, b in zip(velocity, s.xyz, old.xyz, strict=True))
        if self.prototypes is None:
            velocity = (*velocity[:2], 0.0)
        return Track(s.cls, s.bbox, s.xyz, velocity, self.clock.scan, self.clock.scan if old is None else old.birth)

    def _position(self, memory: Recovery, name: str, s: Seen, tried: dict) -> tuple[tuple | None, str | None]:
        """A sighting's position, its own or that of an accepted candidate, and where it comes from."""
        if s.cls != "PERSON":
            return s.xyz, None if s.xyz is None else "NORMAL_COMPONENT"
        if s.xyz is not None:
            memory.observe(name, s.xyz, self.clock.scan)
            return s.xyz, "NORMAL_COMPONENT"
        if not self.recover:
            return None, "UNAVAILABLE"
        taken, _ = memory.consider(name, s.candidate, self.clock.scan)
        tried["attempts"] += s.candidate is not None
        if not taken:
            return None, "UNAVAILABLE"
        tried["accepted"] += 1
        self.tracks[name] = self.tracks[name]._replace(xyz=s.candidate["xyz"])
        return s.candidate["xyz"], "RECOVERED_SUPPRESSED_COMPONENT"

    def _correct(self, ns: int, names, seen, positions, sources) -> None:
        for name, s, xyz, source in zip(names, seen, positions, sources, strict=True):
            if xyz is None:
                continue
            old, velocity = self.motions.get(name), (0.0, 0.0, 0.0)
            if old is not None and (dt := (ns - old.ns) / 1e9) > 1e-6:
                velocity = (*(M.EWMA_KEEP * v + M.EWMA_NEW * (a - b) / dt for v, a, b in zip(old.velocity[:2], xyz, old.xyz, strict=False)), 0.0)
            age = self.clock.scan - self.tracks[name].birth + 1
            self.motions[name] = Motion(s.cls, tuple(xyz), velocity, ns, -1 if old is None else old.reported, s.bbox, s.conf, source, age)

    def _forget(self, ns: int) -> None:
        """Drop what can no longer matter."""
        self.tracks = {k: t for k, t in self.tracks.items() if self.clock.scan - t.last <= self.max_age}
        self.motions = {k: m for k, m in self.motions.items() if ns - m.ns <= MOTION_TTL_NS}
        known = self.prototypes or {}
        self.trails = {k: t for k, t in self.trails.items() if k in self.tracks or k in known}
        self.seeds = {k: s for k, s in self.seeds.items() if k in self.tracks}

    # images

    def image(self, ns: int, seen: list[Seen]) -> list[dict]:
        self.clock = self.clock._replace(image=self.clock.image + 1)
        ahead = {k: self._ahead(m, ns) for k, m in sorted(self.motions.items()) if m.ns <= ns}
        fresh = {k for k in ahead if ns - self.motions[k].ns <= M.FRESH_NS}
        named = self._matched(seen, ahead, fresh)
        self._anonymous(seen, named)
        rows, reported = [], []
        for i, s in enumerate(seen):
            name = named[i]
            m, here = self.motions.get(name) if name in ahead else None, name in fresh
            if self.prototypes is None and not here:
                continue
            source = "LIDAR_MEASUREMENT" if here and m.ns > m.reported else "CAUSAL_PREDICTION"
            if m is not None:
                self.motions[name] = m._replace(bbox=s.bbox, conf=s.conf)
            if source == "LIDAR_MEASUREMENT":
                reported.append(name)
            v = m.velocity if m is not None else (0.0, 0.0)
            horizon = (ns - m.ns) / 1e6 if m is not None else None
            status = "FRESH" if here else "STALE" if m is not None else "UNAVAILABLE"
            rows.append({"ns": ns, "kind": IMAGE, "det": s.det, "track_id": name, "cls": s.cls, "vx": v[0], "vy": v[1], "fresh": here, "state_source": source, "state_status": status, "horizon_ms": horizon, "measurement_source": None if m is None else m.source, "identity": self._identity(name)} | _place(ahead[name] if here else None))
        for name in reported:
            self.motions[name] = self.motions[name]._replace(reported=self.motions[name].ns)
        return rows

    @staticmethod
    def _ahead(m: Motion, ns: int) -> tuple:
        dt = (ns - m.ns) / 1e9
        return m.xyz[0] + m.velocity[0] * dt, m.xyz[1] + m.velocity[1] * dt, m.xyz[2]

    def _matched(self, seen: list[Seen], ahead: dict, fresh: set) -> dict[int, str]:
        named: dict[int, str] = {}
        for cls in ("PERSON", "ROBOT"):
            tracks = [k for k in ahead if k in fresh and self.motions[k].cls == cls]
            rows = [i for i, s in enumerate(seen) if s.cls == cls]
            if not tracks or not rows:
                continue
            cost = np.full((len(tracks), len(rows) + len(tracks)), M.ASSOCIATION_DUMMY)  # a column of its own for each track
            for r, k in enumerate(tracks):
                if (p := pixel(*ahead[k])) is not None:
                    cost[r, : len(rows)] = [box_cost(p, seen[i].bbox) for i in rows]
            named |= {rows[c]: tracks[r] for r, c in accepted(cost, M.ASSOCIATION_LIMIT) if c < len(rows)}
        left = [i for i, s in enumerate(seen) if s.cls == "ROBOT" and i not in named]
        if self.prototypes is not None and left and ROBOT in ahead and ROBOT not in named.values():
            named[max(left, key=lambda i: seen[i].conf)] = ROBOT
        return named

    def _anonymous(self, seen: list[Seen], named: dict[int, str]) -> None:
        """Ids by overlap within a class for what has no track; an id is used up even if its row is not reported."""
        now = self.clock.image
        known = {k: b for k, b in sorted(self.boxes.items()) if now - b.image <= self.max_age}
        left = [i for i in range(len(seen)) if i not in named]
        if known and left:
            like = lambda b, s: 1 - o if b.cls == s.cls and (o := overlap(b.bbox, s.bbox)) >= 0.1 else INFEASIBLE
            for r, c in accepted(np.array([[like(b, seen[i]) for i in left] for b in known.values()]), 0.9):
                named[left[c]] = list(known)[r]
        for i in left:
            if i not in named:
                named[i] = f"A{self.clock.next_box:04d}"
                self.clock = self.clock._replace(next_box=self.clock.next_box + 1)
            known[named[i]] = Box(seen[i].cls, seen[i].bbox, now)
        self.boxes = known


def _place(xyz: tuple | None) -> dict:
    return dict(zip("xyz", xyz or (None,) * 3, strict=True))


def _none(*v: float) -> tuple | None:
    return None if any(x is None or x is pd.NA or isnan(x) for x in v) else tuple(map(float, v))


def _seen(r) -> Seen:
    candidate = None
    if _none(r.rn) is not None:
        candidate = {"xyz": _none(r.rx, r.ry, r.rz), "n": int(r.rn), "score": float(r.rscore), "inside": bool(r.rinside), "plausible": bool(r.rplausible), "competition": bool(r.rcompetition), "ambiguous": bool(r.rambiguous)}
    vector = None if r.vector is None or len(r.vector) == 0 else tuple(map(float, r.vector))
    return Seen(int(r.det), r.cls, float(r.conf), tuple(map(float, (r.x1, r.y1, r.x2, r.y2))), _none(r.x, r.y, r.z), vector, candidate)


def _step(path: Path, ns: int, kind: int, rows: Iterable) -> list[dict]:
    seen = sorted((_seen(r) for r in rows if r.det >= 0), key=lambda s: s.det)
    out = path.scan(ns, seen) if kind == SCAN else path.image(ns, seen)
    path.clock = path.clock._replace(done_ns=ns, done_kind=kind)
    return out


def _frame(scene: int, variant: str | None, rows: list[dict]) -> pd.DataFrame:
    d = pd.DataFrame(rows, columns=list(_OUT)).assign(scene=scene, variant=variant)
    text = [c.split()[0] for c in ONLINE.split(", ") if c.endswith(" string")]
    return d.astype({c: "Int32" for c in COUNTS} | {"fresh": "boolean", "ns": "int64", "kind": "int32", "det": "int32"} | dict.fromkeys(text, object))


_unit = lambda r: (r.scene, None if pd.isna(r.variant) else r.variant, r.ns, r.kind)


def _rows(sightings: DataFrame) -> DataFrame:
    held = sightings if "variant" in sightings.columns else sightings.withColumn("variant", F.lit(None).cast("string"))
    return held.select(*COLUMNS)


def fan_out(sightings: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Each row once for each variant that its own name stands for (name: variants); rows of other names are left out."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in variants.items() for x in kv])
    return sightings.withColumn("variant", F.explode(table[F.col("variant")])).select(*COLUMNS)


def mirrors(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(left, right, differing): rows that one variant of a pair has and the other has not, or not as often; 0 for variants that must agree."""
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs]))
    d = rows.withColumn("_p", pair).where(F.col("variant").isin(F.col("_p.left"), F.col("_p.right")))
    n = d.groupBy("_p", *[c for c in rows.columns if c != "variant"]).agg(F.sum(F.when(F.col("variant") == F.col("_p.left"), 1).otherwise(-1)).alias("n"))
    return n.groupBy("_p.left", "_p.right").agg(F.sum(F.abs("n")).alias("differing"))


def batch(sightings: DataFrame, variants: dict[str, dict] | None = None, **options) -> DataFrame:
    """The path over all scenes and variants of a table; a task streams them in order and holds one unit.

    ``options`` are those of ``Path`` for all, ``variants`` the further ones by variant.
    """
    of_variant = variants or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, of, out = Path(), (None, None), []
        rows = chain.from_iterable(f.itertuples(index=False) for f in frames)
        for (*key, ns, kind), unit in groupby(rows, key=_unit):
            if key != of or len(out) > 4096:
                if out:
                    yield _frame(*of, out)
                path, of, out = path if key == of else Path(**options | of_variant.get(key[1], {})), key, []
            out += _step(path, int(ns), int(kind), unit)
        if out:
            yield _frame(*of, out)

    rows = _rows(sightings.where(sightings["ns"] < END))
    # with a number of its own, as a fold takes far longer than its few bytes let Spark's merging of partitions expect
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "scene", "variant").sortWithinPartitions("scene", "variant", "ns", "kind", "det").mapInPandas(run, ONLINE)


#: Schemas of the typed state; its rows cannot have a field named cls.
MAPS = {
    "tracks": ("track_id string", "entity string, bbox array<double>, xyz array<double>, velocity array<double>, last long, birth long", Track),
    "motions": ("track_id string", "entity string, xyz array<double>, velocity array<double>, ns long, reported long, bbox array<double>, conf double, source string, age long", Motion),
    "boxes": ("box_id string", "entity string, bbox array<double>, image long", Box),
    "trails": ("track_id string", "xyz array<double>, velocity array<double>, frame long", None),
    "seeds": ("track_id string", "xyz array<double>, frame long, length long", None),
}
CLOCK = ", ".join(f"{c} long" for c in Clock._fields)


def _plain(value) -> tuple:
    """A value of a map as plain numbers, to be compared and stored."""
    value = value[:3] if isinstance(value, Trail) else value
    return tuple([float(x) for x in v] if isinstance(v, (tuple, list, np.ndarray)) else v for v in value)


def _restored(name: str, value) -> NamedTuple:
    if name == "trails":
        return Trail(np.array(value[0]), np.array(value[1]), value[2], None)
    if name == "seeds":
        return Seeds(np.array(value[0]), value[1], value[2])
    return MAPS[name][2](*[tuple(v) if isinstance(v, (list, tuple, np.ndarray)) else v for v in value])


_Row = namedtuple("_Row", COLUMNS)


def _value(v):
    """A cell of a pandas row as the plain value that list state takes."""
    if v is None or v is pd.NA or isinstance(v, float) and isnan(v):
        return None
    return v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v


class OnlinePath(StatefulProcessor):
    """The path as an operator of a stream.

    Rows of a scene's latest unit wait until a later one begins, or until a row of the time END; rows of units
    that are done are counted as late and left out.
    """

    def __init__(self, options: dict, variants: dict[str, dict]):
        self.options, self.variants = options, variants

    def init(self, handle) -> None:
        self.maps = {name: handle.getMapState(name, key, value) for name, (key, value, _) in MAPS.items()}
        self.clock = handle.getValueState("clock", CLOCK)
        self.waiting = handle.getListState("waiting", SIGHTING.replace("cls string", "entity string"))

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        path = Path(**self.options | self.variants.get(key[1], {}))
        held: dict[str, dict[str, tuple]] = {}
        if self.clock.exists():
            path.clock = Clock(*self.clock.get())
        for name, m in self.maps.items():
            stored = {k[0]: tuple(v) for k, v in m.iterator()}
            held[name] = {k: _plain(v) for k, v in stored.items()}
            setattr(path, name, {k: _restored(name, v) for k, v in stored.items()})
        waiting = [_Row(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        come = waiting + [_Row(*map(_value, (getattr(r, c) for c in COLUMNS))) for part in rows for r in part.itertuples(index=False)]
        real = sorted((r for r in come if r.ns < END), key=lambda r: (r.ns, r.kind, r.det))
        done = (path.clock.done_ns, path.clock.done_kind)
        late = [r for r in real if (r.ns, r.kind) <= done]
        real = real[len(late) :]
        last = _unit(real[-1]) if real and len(late) + len(real) == len(come) else None
        out = [{"ns": late[-1].ns, "kind": LATE, "det": -1, "late": len(late)}] if late else []
        keep: list[_Row] = []
        for unit, part in groupby(real, key=_unit):
            if unit == last:
                keep = list(part)
            else:
                out += _step(path, int(unit[2]), int(unit[3]), part)
        for name, m in self.maps.items():
            now = {k: _plain(v) for k, v in getattr(path, name).items()}
            for k in held[name].keys() - now.keys():
                m.removeKey((k,))
            for k, v in now.items():
                if held[name].get(k) != v:
                    m.updateValue((k,), v)
        self.clock.update(tuple(path.clock))
        self.waiting.put([tuple(r) for r in keep]) if keep else self.waiting.clear()
        if out:
            yield _frame(int(key[0]), key[1], out)

    def close(self) -> None:
        pass


def stream(sightings: DataFrame, variants: dict[str, dict] | None = None, **options) -> DataFrame:
    """The path over a stream; the session must keep state in RocksDB (see ``with_rocksdb``)."""
    return _rows(sightings).groupBy("scene", "variant").transformWithStateInPandas(OnlinePath(options, variants or {}), ONLINE, "append", "none")
