"""Rigid transforms, camera projection, ground plane, voxels and calibration geometry as Column expressions."""

from __future__ import annotations

from math import atan2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fusegrid.functions import model as M


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rigid(x, y, z, t: np.ndarray) -> tuple[Column, Column, Column]:
    """The point moved by the 4x4 transform ``t``."""
    x, y, z = _c(x), _c(y), _c(z)
    return tuple(x * float(r[0]) + y * float(r[1]) + z * float(r[2]) + float(r[3]) for r in np.asarray(t)[:3])


def inverse_chain(*transforms: np.ndarray) -> np.ndarray:
    """inv(t1) @ inv(t2) @ ...: one constant on the driver."""
    out = np.eye(4)
    for t in transforms:
        out = out @ np.linalg.inv(t)
    return out


def finite(*values) -> Column:
    out = F.lit(True)
    for v in map(_c, values):
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return out


def _rays(camera, nearest: float, farthest: float | None) -> tuple[Column, Column, Column]:
    """(a, b, valid): the camera-frame point over its depth, null where the depth is not finite or out of bounds.

    A coordinate that is not finite makes the depth so; NaN sorts over all numbers, so one upper bound excludes both.
    """
    cx, cy, cz = map(_c, camera)
    valid = F.coalesce((cz > nearest) & (cz < (float("inf") if farthest is None else farthest)), F.lit(False))
    z = F.when(valid, cz)
    return cx / z, cy / z, valid


def _distorted(a, b, du: float, dv: float) -> tuple[Column, Column]:
    a, b = _c(a), _c(b)
    k1, k2, p1, p2, k3 = M.DISTORTION
    r2 = a * a + b * b
    radial = r2 * (r2 * (r2 * k3 + k2) + k1) + 1.0
    u = (a * radial + a * b * (2 * p1) + (r2 + a * a * 2.0) * p2) * M.FX + (M.CX + du)
    v = (b * radial + (r2 + b * b * 2.0) * p1 + a * b * (2 * p2)) * M.FY + (M.CY + dv)
    return u, v


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose expressions the optimizer does not copy into later filters and projections.

    A generator of one row stands between: deep expressions would else be inlined once for each use.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_projection(df: DataFrame, x: str = "x", y: str = "y", z: str = "z", t: np.ndarray = M.OPTICAL_FROM_ANNOTATED, shift: str = "physical", nearest: float = 1e-8, farthest: float | None = None) -> DataFrame:
    """``df`` with u, v (null where not valid), valid and depth of points of the annotated frame, under a named registration shift."""
    cx, cy, cz = rigid(x, y, z, t)
    d = bound(df, _cx=cx, _cy=cy, depth=cz)
    a, b, valid = _rays(("_cx", "_cy", "depth"), nearest, farthest)
    d = bound(d, _a=a, _b=b, valid=valid)
    u, v = _distorted("_a", "_b", *M.SHIFTS[shift])
    return bound(d, u=u, v=v).drop("_a", "_b", "_cx", "_cy")


def in_view(u, v, depth) -> Column:
    u, v = _c(u), _c(v)
    return F.coalesce((_c(depth) > 0) & (u >= 0) & (u < M.WIDTH) & (v >= 0) & (v < M.HEIGHT), F.lit(False))


def ground_height(x, y, z, normal=M.GROUND_NORMAL, d: float = M.GROUND_D, normalized: bool = False) -> Column:
    """Signed height over the plane; divided by the normal's length only if ``normalized``."""
    n = float(np.linalg.norm(normal))
    if normalized and not (np.isfinite(n) and n > 1e-12):
        raise ValueError("ground-plane normal must be finite and non-zero")
    h = _c(x) * float(normal[0]) + _c(y) * float(normal[1]) + _c(z) * float(normal[2]) + d
    return h / n if normalized else h


def ground_z(x, y, normal=M.GROUND_NORMAL, d: float = M.GROUND_D) -> Column:
    return -(_c(x) * float(normal[0]) + _c(y) * float(normal[1]) + d) / float(normal[2])


def within(h, limits: tuple[float, float]) -> Column:
    return F.coalesce(_c(h).between(*limits), F.lit(False))


def voxel(*values, size: float = M.VOXEL_M) -> list[Column]:
    return [F.floor(_c(v) / size).cast("int") for v in values]


def cell_code(*keys, bits: int = 21) -> Column:
    """Integer cells packed in one long, ``bits`` each (keys of either sign)."""
    out = F.lit(0).cast("long")
    for k in keys:
        out = F.shiftleft(out, bits).bitwiseOR((_c(k).cast("long") + F.lit(1 << (bits - 1))).bitwiseAND(F.lit((1 << bits) - 1)))
    return out


def corners(x, y, z, sx, sy, sz, yaw) -> Column:
    """The eight corners of a cuboid as an array of struct(x, y, z)."""
    x, y, z, sx, sy, sz, yaw = map(_c, (x, y, z, sx, sy, sz, yaw))
    c, s = F.cos(yaw), F.sin(yaw)
    out = []
    for i in (-0.5, 0.5):
        for j in (-0.5, 0.5):
            for k in (-0.5, 0.5):
                out.append(F.struct((x + c * sx * i - s * sy * j).alias("x"), (y + s * sx * i + c * sy * j).alias("y"), (z + sz * k).alias("z")))
    return F.array(*out)


def circle(segments: int) -> list[tuple[float, float]]:
    """Cosine and sine of the segments' first edges."""
    return [(float(np.cos(a)), float(np.sin(a))) for a in np.linspace(0.0, 2 * np.pi, segments, endpoint=False)]


def cylinder(x, y, cls: str = "PERSON", segments: int = 12) -> Column:
    """Vertices of a display cylinder that stands on the ground: bottom ring, then top ring, as struct(x, y, z)."""
    radius, height = M.CYLINDER[cls]
    x, y = _c(x), _c(y)
    base = ground_z(x, y)
    out = []
    for top in (0.0, height):
        for c, s in circle(segments):
            out.append(F.struct((x + radius * c).alias("x"), (y + radius * s).alias("y"), (base + top).alias("z")))
    return F.array(*out)


def length(dx: Column, dy: Column) -> Column:
    """The plain root of the squares: ``F.hypot`` rounds otherwise in the last place, so that equal distances can come out unequal."""
    return F.sqrt(dx * dx + dy * dy)


@F.pandas_udf(DoubleType())
def _angle(y: pd.Series, x: pd.Series) -> pd.Series:
    """The arctangent of the C library, which rounds almost always to the nearest double; Java's is one off now and then."""
    return pd.Series(map(atan2, y.to_numpy(), x.to_numpy()), dtype="float64")


def spherical(x, y, z) -> tuple[Column, Column, Column]:
    """(range, azimuth, elevation), angles in degrees; points in one direction have the same angles, to the last place."""
    x, y, z = _c(x), _c(y), _c(z)
    return F.sqrt(x * x + y * y + z * z), F.degrees(_angle(y, x)), F.degrees(_angle(z, length(x, y)))


def ring(elevation, first: float = -15.0, step: float = 2.0, count: int = 16, limit: float = 0.75) -> tuple[Column, Column]:
    """(nearest ring, whether it is within the limit); a tie goes to the lower ring."""
    e = _c(elevation)
    k = F.greatest(F.lit(0), F.least(F.lit(count - 1), F.ceil((e - first) / step - 0.5))).cast("int")
    return k, F.abs(e - (k * step + first)) < limit


def calibration_residual(u, box_x1, box_x2, conf, n, depth) -> Column:
    """Signed column offset of a box centre against the projected component, or null where a gate fails."""
    u, x1, x2 = _c(u), _c(box_x1), _c(box_x2)
    target = (x1 + x2) * 0.5
    residual = target - u
    ok = (_c(conf) >= 0.5) & (_c(n) >= 3) & (_c(depth) > 0) & (F.abs(residual) <= F.greatest(F.lit(100.0), (x2 - x1) * 0.75)) & residual.between(-80.0, 120.0)
    return F.when(ok, residual)


def causal_age_ms(rgb_ns, lidar_ns, slop_ms: float = M.SYNC_SLOP_MS) -> Column:
    """Age of the image support; raises for a future image or one past the window."""
    age = (_c(lidar_ns) - _c(rgb_ns)) / 1e6
    return F.when(_c(rgb_ns) > _c(lidar_ns), F.raise_error(F.lit("future RGB support is forbidden")).cast("double")).when(age > slop_ms, F.raise_error(F.lit("RGB support exceeds the synchronization window")).cast("double")).otherwise(age)


def rotated(x, y, z, rotation: tuple[float, float, float], shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[Column, Column, Column]:
    """A point turned by a rotation vector (axis times angle), then shifted."""
    angle = float(np.linalg.norm(rotation))
    axis = np.asarray(rotation) / angle if angle > 0 else np.zeros(3)
    turn = np.eye(3)
    if angle > 0:
        k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
        turn = turn * np.cos(angle) + np.sin(angle) * k + (1 - np.cos(angle)) * np.outer(axis, axis)
    return rigid(x, y, z, np.column_stack((turn, shift)))


def age_state(age, limit: int) -> Column:
    """within (the limit included), too_old or future."""
    a = _c(age)
    return F.when(a < 0, "future").when(a <= limit, "within").otherwise("too_old")


def fresh(horizon, limit: int = M.FRESH_NS) -> Column:
    """Whether a state is recent enough, the limit included; null where it lies ahead, as such rows are not reported."""
    h = _c(horizon)
    return F.when(h >= 0, h <= limit)
