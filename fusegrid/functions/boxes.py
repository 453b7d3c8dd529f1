"""Boxes, costs, scores, gates and bins as Column expressions.  A box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fusegrid.functions import model as M


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def box(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2"))


def _sides(b) -> tuple[Column, Column]:
    return F.greatest(b[2] - b[0], F.lit(1.0)), F.greatest(b[3] - b[1], F.lit(1.0))


def intersection(a, b) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def area(b) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a, b) -> Column:
    both = intersection(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-9))


def over_smaller(a, b) -> Column:
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1e-9))


def to_xyxy(x, y, w, h) -> tuple[Column, ...]:
    x, y = _c(x), _c(y)
    return x, y, x + _c(w), y + _c(h)


def to_xywh(b) -> tuple[Column, ...]:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def inside(u, v, b) -> Column:
    """Bounds included."""
    return _c(u).between(b[0], b[2]) & _c(v).between(b[1], b[3])


def _outside(u, v, b) -> tuple[Column, Column]:
    u, v, (w, h) = _c(u), _c(v), _sides(b)
    return F.greatest(b[0] - u, F.lit(0.0), u - b[2]) / w, F.greatest(b[1] - v, F.lit(0.0), v - b[3]) / h


def center_distance(u, v, b) -> Column:
    """Distance to the box's centre in units of its sides: the ownership score."""
    w, h = _sides(b)
    return F.hypot((_c(u) - (b[0] + b[2]) / 2) / w, (_c(v) - (b[1] + b[3]) / 2) / h)


def box_cost(u, v, b) -> Column:
    return F.hypot(*_outside(u, v, b)) * 0.7 + center_distance(u, v, b) * 0.3


def soft_cost(u, v, b, margin) -> Column:
    """Soft ownership cost within the side margin and 3 % above or below; null outside."""
    ox, oy = _outside(u, v, b)
    return F.when((ox <= _c(margin)) & (oy <= 0.03), center_distance(u, v, b) + F.hypot(ox, oy) * 2.0)


def component_score(u, v, b, hspan, vspan, n) -> Column:
    """Distance to the upper-body target plus span penalties less a bonus for points; null without a projection."""
    w, h = _sides(b)
    hs, vs, zero = _c(hspan), _c(vspan), F.lit(0.0)
    center = F.hypot((_c(u) - (b[0] + b[2]) / 2) / w, (_c(v) - (b[1] + h * 0.54)) / h)
    small = F.greatest(zero, F.lit(0.1) - hs) + F.greatest(zero, F.lit(0.1) - vs)
    large = F.greatest(zero, hs - 1.1) + F.greatest(zero, vs - 2.2) * 0.5
    return center + small * 0.35 + large * 0.45 - F.log1p(_c(n).cast("double")) * 0.055


def motion_gate(gap) -> Column:
    return F.least(F.greatest(_c(gap), F.lit(1)), F.lit(5)) * 0.18 + 0.7


def track_cost(distance, gap, overlap) -> Column:
    """Cost of a track and a detection; distance null where either has no position; null: infeasible."""
    d, o, gate = _c(distance), _c(overlap), motion_gate(gap)
    near = F.when(d <= gate, d / gate * 0.75 + (F.lit(1.0) - o) * 0.25)
    return F.when(d.isNull(), F.when(o >= 0.1, (F.lit(1.0) - o) * 0.3 + 0.7)).otherwise(near)


def identity_gate(gap_s) -> Column:
    return F.least(F.lit(3.0), F.greatest(_c(gap_s), F.lit(0.0)) * 1.5 + 0.75)


def plausible(hspan, vspan, cls: str = "PERSON") -> Column:
    a, b, c, d = M.PLAUSIBLE[cls]
    return _c(hspan).between(a, b) & _c(vspan).between(c, d)


def log_ratio(a, b) -> Column:
    floor = lambda x: F.greatest(_c(x).cast("double"), F.lit(1e-6))
    return F.abs(F.ln(floor(a) / floor(b)))


def region(u, v) -> Column:
    """One of nine image regions, half-open bins."""
    u, v = _c(u), _c(v)
    row = F.when(v < M.HEIGHT / 3, "top").when(v < 2 * M.HEIGHT / 3, "middle").otherwise("bottom")
    column = F.when(u < M.WIDTH / 3, "left").when(u < 2 * M.WIDTH / 3, "center").otherwise("right")
    return F.concat_ws("_", row, column)


def depth_bin(d) -> Column:
    d = _c(d)
    return F.when(d < 3, "0-3m").when(d < 6, "3-6m").when(d < 9, "6-9m").otherwise(">9m")


def size_bin(height_px) -> Column:
    h = _c(height_px)
    return F.when(h < 100, "small").when(h < 250, "medium").otherwise("large")


def correspondence_cost(a, b) -> Column:
    """1 - IoU + .55 centre distance + .2 |ln width ratio| + .2 |ln height ratio| of box a against b."""
    (aw, ah), (bw, bh) = _sides(a), _sides(b)
    center = F.hypot(((a[0] + a[2]) - (b[0] + b[2])) / 2 / bw, ((a[1] + a[3]) - (b[1] + b[3])) / 2 / bh)
    return F.lit(1.0) - iou(a, b) + center * 0.55 + F.abs(F.ln(aw / bw)) * 0.2 + F.abs(F.ln(ah / bh)) * 0.2


def quality_guard(in_box: Column, is_plausible: Column, score, limit: float = M.ASSOCIATION_DUMMY) -> Column:
    return in_box & is_plausible & (_c(score) <= limit)


def case_metrics(u, v, proxy, b) -> dict[str, Column]:
    """How a target's proxy box and its centre lie beside a box."""
    u, v = _c(u), _c(v)
    (pw, ph), (w, h) = _sides(proxy), _sides(b)
    center = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    border = (proxy[0] <= 0) | (proxy[1] <= 0) | (proxy[2] >= M.WIDTH - 1) | (proxy[3] >= M.HEIGHT - 1)
    return {
        "du": center[0] - u, "dv": center[1] - v, "width_ratio": pw / w, "height_ratio": ph / h, "iou": iou(proxy, b), "over_smaller": over_smaller(proxy, b),
        "center_in_box": inside(u, v, b), "box_center_in_proxy": inside(*center, proxy), "proxy_at_border": border, "size": size_bin(b[3] - b[1]), "cost": correspondence_cost(proxy, b),
    }
