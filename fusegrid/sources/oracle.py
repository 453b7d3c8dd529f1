"""The same relations as DuckDB common table expressions, for the oracles."""

from __future__ import annotations

from fusegrid.functions import model as M


def n(x: float) -> str:
    """A double literal (a plain one would be a decimal)."""
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def rigid(t, x="x", y="y", z="z") -> tuple[str, str, str]:
    return tuple(f"({x} * ({n(r[0])}) + {y} * ({n(r[1])}) + {z} * ({n(r[2])}) + ({n(r[3])}))" for r in t[:3])


POINTS = """points AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pid FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_orderkey / 125e0) AS BIGINT) AS frame,
    (l_partkey * 37 + l_linenumber * 11) % 900 / 1e2 + 1e0 AS x, (l_suppkey * 53 + l_orderkey * 17) % 800 / 1e2 - 4e0 AS y,
    (l_partkey * 13 + l_suppkey * 29) % 240 / 1e2 - 2.2e0 AS z FROM lineitem))"""

_X, _Y, _Z = rigid(M.OPTICAL_FROM_ANNOTATED)
_K1, _K2, _P1, _P2, _K3 = map(n, M.DISTORTION)
_G = M.GROUND_NORMAL


def projected(shift: str = "inference") -> str:
    du, dv = M.SHIFTS[shift]
    return f"""camera AS (SELECT *, {_X} AS cx, {_Y} AS cy, {_Z} AS cz FROM points),
rays AS (SELECT *, cz > 1e-8 AS valid, cx / CASE WHEN cz > 1e-8 THEN cz END AS a, cy / CASE WHEN cz > 1e-8 THEN cz END AS b FROM camera),
radial AS (SELECT *, a * a + b * b AS r2 FROM rays),
proj AS (SELECT frame, pid, x, y, z, valid, cz AS depth, x * ({n(_G[0])}) + y * ({n(_G[1])}) + z * ({n(_G[2])}) + ({n(M.GROUND_D)}) AS h,
  (a * (1e0 + r2 * ({_K1}) + r2 * r2 * ({_K2}) + r2 * r2 * r2 * ({_K3})) + a * b * (2 * ({_P1})) + (r2 + a * a * 2e0) * ({_P2})) * {n(M.FX)} + {n(M.CX)} + {n(du)} AS u,
  (b * (1e0 + r2 * ({_K1}) + r2 * r2 * ({_K2}) + r2 * r2 * r2 * ({_K3})) + (r2 + b * b * 2e0) * ({_P1}) + a * b * (2 * ({_P2}))) * {n(M.FY)} + {n(M.CY)} + {n(dv)} AS v FROM radial)"""


BOXES = """boxes AS (SELECT frame, det, 'PERSON' AS cls, x1, y1, x1 + 120 + det * 30 AS x2, y1 + 240 + det * 20 AS y2, ((frame * 37 + det * 11) % 70 + 30) / 1e2 AS conf FROM (
  SELECT frame, det, CAST((frame * 131 + det * 257) % 1000 AS DOUBLE) AS x1, CAST((frame * 71 + det * 97) % 400 AS DOUBLE) AS y1
  FROM (SELECT DISTINCT frame FROM points) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS det)))"""

OCC = "occ AS (SELECT (s_suppkey * 379) % 900 / 1e2 + 1e0 AS ox, (s_suppkey * 631) % 800 / 1e2 - 4e0 AS oy FROM supplier)"

GATED = f"gated AS (SELECT * FROM proj WHERE valid AND depth > 0 AND u >= 0 AND u < {M.WIDTH} AND v >= 0 AND v < {M.HEIGHT} AND h BETWEEN 0.03e0 AND 2.15e0)"

OWNED = """owned AS (SELECT * EXCLUDE (rn) FROM (SELECT g.*, b.det, b.x1, b.y1, b.x2, b.y2, b.conf,
  row_number() OVER (PARTITION BY g.frame, g.pid ORDER BY sqrt(power((u - (x1 + x2) / 2) / greatest(x2 - x1, 1e0), 2) + power((v - (y1 + y2) / 2) / greatest(y2 - y1, 1e0), 2)), det) AS rn
  FROM gated g JOIN boxes b ON g.frame = b.frame AND u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2) WHERE rn = 1)"""

BASE = ",\n".join((POINTS, projected(), BOXES, GATED, OWNED))


def events(kind: str, name: str) -> str:
    return f"{name} AS (SELECT event_id AS idx, epoch_us(ts) AS ts FROM events WHERE event_type = '{kind}')"


MEASUREMENTS = "measurements AS (SELECT user_id AS track, epoch_us(ts) AS t, event_id, value AS x, CAST(event_id * 7 % 13 AS DOUBLE) AS y FROM events)"


def placed(name: str, index: str, left_out: int, nudge: float = 0.0) -> str:
    off = f"(k * 31 % 47) * {n(nudge)}"
    return f"""{name} AS (SELECT CAST(k // 3 AS BIGINT) AS frame, CAST(k % 3 AS INTEGER) AS {index}, (k * 7 * 17) % 997 / 1e2 + {off} AS x,
  (k * 11 * 19) % 991 / 1e2 - {off} AS y, (k * 13 * 3) % 211 / 1e2 AS z FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % {left_out} <> 0))"""


LOGS = """o AS (SELECT o_orderkey AS frame, 'T' || CAST(o_custkey % 5 AS VARCHAR) AS track_id, round(o_totalprice * 1e0, 2) AS x, o_orderstatus AS state FROM orders),
la AS (SELECT * FROM o WHERE frame % 11 <> 3),
lb AS (SELECT frame, track_id, CASE WHEN frame % 5 = 0 THEN x + 0.25e0 ELSE x END AS x, CASE WHEN frame % 13 = 0 THEN NULL ELSE state END AS state FROM o WHERE frame % 7 <> 2)"""
