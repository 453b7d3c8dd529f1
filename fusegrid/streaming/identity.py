"""Persistent identities over raw tracks of one scene.

A frame is a round of claims on identities.  Holders come first: a track that holds an
identity keeps it unless its memory says otherwise.  Tracks named like an identity that
nobody remembers claim it next.  What is then unclaimed is compared with the people that are
left, all at once.  Claims are kept by identity, so none can be given twice; memories change
once, when all claims are in.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import hypot, inf
from typing import NamedTuple

import numpy as np

from fusegrid.functions import model as M
from fusegrid.streaming.states import INFEASIBLE, accepted

#: fixed values: states, and the limits of time (ns), reach (m, m/s, m) and weight of evidence
CONFIRMED, RECOVERED, LOST, ANONYMOUS = "CONFIRMED", "RECOVERED", "TEMPORARILY_LOST", "ANONYMOUS"
RESERVED_NS, REMEMBERED_NS = 1_200_000_000, 2_000_000_000
REACH, REACH_PER_S, MOST_REACH = 0.75, 1.5, 3.0
LOOK_WEIGHT, MOTION_WEIGHT = 0.6, 0.4


class Evidence(NamedTuple):
    """How far a person is from where an identity should be, how far it may be, and how unlike it looks; inf where unknown."""

    distance: float
    reach: float
    look: float

    def against(self, limit: float) -> str | None:
        if self.distance > self.reach:
            return "MOTION_INCOMPATIBLE"
        return "APPEARANCE_INCOMPATIBLE" if self.look > limit else None


class Claim(NamedTuple):
    row: int
    state: str
    source: str


@dataclass
class Memory:
    """One identity: the track that had it last and whether it still holds it, when and where it was seen, and how it moves."""

    owner: str
    holds: bool
    state: str
    confirmed: int
    seen: int
    xyz: np.ndarray | None = None
    xyz_ns: int | None = None
    velocity: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def since(self, ns: int) -> float:
        """Seconds since the last position, or else the last sight."""
        return (ns - (self.seen if self.xyz_ns is None else self.xyz_ns)) / 1e9

    def motion(self, xyz, ns: int) -> tuple[float, float]:
        gap = max(self.since(ns), 0.0)
        reach = min(MOST_REACH, REACH + REACH_PER_S * gap)
        if xyz is None or self.xyz is None:
            return inf, reach
        ahead = self.xyz + self.velocity * gap
        return hypot(xyz[0] - ahead[0], xyz[1] - ahead[1]), reach

    def seen_at(self, track: str, state: str, xyz, ns: int) -> None:
        if xyz is not None:
            here = np.asarray(xyz, float)
            if self.xyz is not None and (dt := self.since(ns)) > 1e-6:
                self.velocity = (M.EWMA_KEEP * self.velocity + M.EWMA_NEW * (here - self.xyz) / dt) * (1, 1, 0)
            self.xyz, self.xyz_ns = here, ns
        self.owner, self.holds, self.state, self.seen = track, True, state, ns


@dataclass
class IdentityManager:
    """Identities named by their prototypes; events are (ns, track, old, new, reason, state before, state after)."""

    prototypes: dict[str, np.ndarray]
    limit: float = M.APPEARANCE_LIMIT
    reserved_ns: int = RESERVED_NS
    remembered_ns: int = REMEMBERED_NS
    memories: dict[str, Memory] = field(default_factory=dict)
    events: list[tuple] = field(default_factory=list)
    last_ns: int | None = None

    def resolve(self, people: list[dict], ns: int) -> list[dict]:
        """The people of one frame (track_id, xyz or None, vector or None) with identity, identity_state and identity_source."""
        if self.last_ns is not None and ns <= self.last_ns:
            raise ValueError(f"frames must come in causal order, but {ns} is not after {self.last_ns}")
        self.last_ns = ns
        claims: dict[str, Claim] = {}
        self._holders(people, ns, claims)
        self._first_seen(people, ns, claims)
        self._absent(ns, claims)
        self._returning(people, ns, claims)
        for name, claim in claims.items():
            person = people[claim.row]
            memory = self.memories.setdefault(name, Memory(person["track_id"], True, claim.state, ns, ns))
            memory.seen_at(person["track_id"], claim.state, person.get("xyz"), ns)
        given = {claim.row: (name, claim.state, claim.source) for name, claim in claims.items()}
        if len(given) != len(claims):
            raise RuntimeError("a person has claimed two identities")
        fields = ("identity", "identity_state", "identity_source")
        return [p | dict(zip(fields, given.get(i, (None, ANONYMOUS, ANONYMOUS)), strict=True)) for i, p in enumerate(people)]

    def _note(self, ns: int, track: str, old, new, reason: str, before: str, after: str) -> None:
        self.events.append((ns, track, old, new, reason, before, after))

    def _holders(self, people, ns, claims) -> None:
        rows: dict[str, int] = {}
        for i, p in enumerate(people):
            rows.setdefault(p["track_id"], i)
        for name, m in sorted(self.memories.items(), key=lambda kv: kv[1].owner):
            if not m.holds or m.owner not in rows:
                continue
            row, lost = rows[m.owner], m.state == LOST
            distance, reach = m.motion(people[row].get("xyz"), ns)
            if lost and ns - m.seen > self.reserved_ns:
                m.holds = False
            elif reach < distance < inf:
                m.holds = False
                self._note(ns, m.owner, name, None, "HARD_PHYSICAL_CONTRADICTION", m.state, ANONYMOUS)
            else:
                claims[name] = Claim(row, CONFIRMED, "SHORT_OCCLUSION_HOLD" if lost else "TRACK_INHERITANCE")
                if lost:
                    self._note(ns, m.owner, name, name, "OWNER_TRACK_RETURNED_WITHIN_RESERVATION", LOST, CONFIRMED)

    def _first_seen(self, people, ns, claims) -> None:
        taken = {c.row for c in claims.values()}
        for i, p in enumerate(people):
            name = p["track_id"]
            if i not in taken and name in self.prototypes and name not in self.memories and name not in claims:
                claims[name] = Claim(i, CONFIRMED, "INITIAL_REID_CONFIRMATION")
                self._note(ns, name, None, name, "FROZEN_BASE_REID_ACCEPTED", ANONYMOUS, CONFIRMED)

    def _absent(self, ns, claims) -> None:
        for name in [n for n in self.memories if n not in claims]:
            m = self.memories[name]
            if ns - m.seen > self.remembered_ns:
                self._note(ns, m.owner, name, None, "FINITE_IDENTITY_MEMORY_EXPIRED", m.state, ANONYMOUS)
                del self.memories[name]
            elif m.state != LOST:
                m.state = LOST
                self._note(ns, m.owner, name, name, "OWNER_TRACK_NOT_OBSERVED", CONFIRMED, LOST)

    def _returning(self, people, ns, claims) -> None:
        taken = {c.row for c in claims.values()}
        rows = [i for i in range(len(people)) if i not in taken]
        names = [n for n in self.memories if n not in claims]
        if not rows or not names:
            return
        table = [[self._evidence(n, people[i], ns) for n in names] for i in rows]
        cost = np.array([[self._cost(e) for e in line] for line in table])
        matched = dict(accepted(cost, 1.0))
        for r, i in enumerate(rows):
            track = people[i]["track_id"]
            if r in matched:
                claims[names[matched[r]]] = Claim(i, RECOVERED, "CAUSAL_RECOVERY")
                self._note(ns, track, None, names[matched[r]], "MOTION_APPEARANCE_AVAILABLE_GLOBAL_MATCH", ANONYMOUS, RECOVERED)
                continue
            nearest = table[r][int(cost[r].argmin())]
            self._note(ns, track, None, None, "RECOVERY_REJECTED_" + (nearest.against(self.limit) or "GLOBAL_ONE_TO_ONE_CONFLICT"), ANONYMOUS, ANONYMOUS)

    def _evidence(self, name: str, person: dict, ns: int) -> Evidence:
        vector = person.get("vector")
        look = inf if vector is None else 1 - float(np.dot(np.asarray(vector, float), self.prototypes[name]))
        return Evidence(*self.memories[name].motion(person.get("xyz"), ns), look)

    def _cost(self, e: Evidence) -> float:
        return INFEASIBLE if e.against(self.limit) else LOOK_WEIGHT * e.look / self.limit + MOTION_WEIGHT * e.distance / e.reach
