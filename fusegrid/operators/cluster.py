"""Adaptive connected components of small point groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.functions import model as M


#: How many pairs are compared at once.
PAIRS = 1 << 18


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels after the links (i, j): least labels spread over them until nothing changes."""
    while len(i):
        a, b = label[i], label[j]
        low, new = np.minimum(a, b), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _ahead(start: np.ndarray, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): points by group and x, and how many of those after each may lie within the greatest radius of its group."""
    n = len(x)
    size = np.diff(np.append(start, n))
    if n and np.isfinite(x).all() and np.isfinite(r).all():
        reach = np.repeat(np.maximum.reduceat(r, start), size)
        key = np.repeat(np.arange(len(start)), size) * (x.max() - x.min() + 2 * reach.max() + 1) + (x - x.min())
        if np.isfinite(key).all():
            order = np.argsort(key, kind="stable")
            key = key[order]
            return order, np.searchsorted(key, key + reach[order] + 4 * np.spacing(key[-1] + reach.max()), "right") - 1 - np.arange(n)
    return np.arange(n), np.repeat(np.append(start[1:], n), size) - 1 - np.arange(n)


def group_labels(start: np.ndarray, xyz: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """The least position reachable within its group for each point; groups follow one another from the positions ``start``.

    i < j are linked within the radius of i.  Only points that are near in x are compared.  Pairs of all groups are compared together,
    ``pairs`` at once (or those of one point), and their links merged into the labels, so the memory does not depend on how large or dense a group is.
    """
    n = len(xyz)
    x, y, z = np.ascontiguousarray(xyz.T)
    r = M.COMPONENT_RADIUS[0] + M.COMPONENT_RADIUS[1] * np.sqrt(x * x + y * y)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
    order, later = _ahead(start, x, r)
    upto = np.cumsum(later)
    label, at = np.arange(n), 0
    while at < n:
        done = upto[at - 1] if at else 0
        end = max(int(np.searchsorted(upto, done + pairs, "right")), at + 1)
        i = np.repeat(np.arange(at, end), later[at:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:end] - later[at:end] - done, later[at:end])
        i, j = order[i], order[j]
        i, j = np.minimum(i, j), np.maximum(i, j)
        dx, dy, dz = x[i] - x[j], y[i] - y[j], z[i] - z[j]
        near = (np.sqrt(dx * dx + dy * dy + dz * dz) <= r[i]) & (group[i] == group[j])
        label, at = _joined(label, i[near], j[near]), end
    return label


def component_labels(xyz: np.ndarray, slab: int = 512) -> np.ndarray:
    """``group_labels`` of one group, a slab of points against all at once."""
    return group_labels(np.zeros(min(len(xyz), 1), int), np.asarray(xyz, float).reshape(-1, 3), max(slab * len(xyz), 1))


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    """The positions at which the first ``keys`` columns change; nulls are a value."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in t.columns[:keys]:
        code = c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _by_group(points: DataFrame, keys: Sequence[str], row: str, made: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, more: Sequence[str] = ()) -> DataFrame:
    """``made`` of all whole groups of a batch and the positions where they start; a task streams its groups in order."""
    names, k = [*keys, row, "x", "y", "z", *more], len(keys)

    def of(t: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from made(t.combine_chunks(), start).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            # the last group may go on in the next batch; its parts are put together only when it ends
            if held and _starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b]), k).tolist() == [0]:
                held.append(b)
                continue
            t = pa.Table.from_batches([*held, b])
            start = _starts(t, k)
            if len(start) > 1:
                yield from of(t.slice(0, start[-1]), start[:-1])
            held = t.slice(start[-1]).combine_chunks().to_batches()
        if held:
            yield from of(pa.Table.from_batches(held), np.zeros(1, int))

    return points.select(*names).repartition(*keys).sortWithinPartitions(*keys, row).mapInArrow(run, schema)


def _xyz(t: pa.Table) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy().astype(float) for c in "xyz"])


def label_components(points: DataFrame, keys: Sequence[str] = ("frame", "det"), row: str = "pid") -> DataFrame:
    """Points with ``label``: the least ``row`` of their component.  Groups are the points of one box.

    A task streams its groups in order and labels all groups of a batch together.
    """
    types = dict(points.dtypes)

    def labelled(t: pa.Table, start: np.ndarray) -> pa.Table:
        return t.append_column("label", t.column(row).take(pa.array(group_labels(start, _xyz(t)))))

    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, row, "x", "y", "z")) + f", label {types[row]}"
    return _by_group(points, keys, row, labelled, schema)


def _quantile(v: np.ndarray, first: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """The quantile of each run of the sorted ``v``, interpolated as ``percentile`` does."""
    at = (n - 1) * p
    low, high = np.floor(at), np.ceil(at)
    a, b = v[first + low.astype(int)], v[first + high.astype(int)]
    return np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b)


def found_components(points: DataFrame, keys: Sequence[str] = ("frame", "det"), row: str = "pid", least: int = M.MIN_COMPONENT_POINTS) -> DataFrame:
    """``components`` of ``label_components`` in one pass: a component's points are in the task that labels them, so only its row leaves it.

    Coordinates are numbers: a point without one is linked with no other, and ``least`` is 2 or more.
    """
    if least < 2:
        raise ValueError("a component has two points at least here")
    types = dict(points.dtypes)
    p, q = M.CENTER_QUANTILES

    def measured(t: pa.Table, start: np.ndarray) -> pa.Table:
        xyz = _xyz(t)
        label = group_labels(start, xyz)
        order = np.argsort(label, kind="stable")
        first = np.flatnonzero(np.diff(label[order], prepend=-1))
        n = np.diff(np.append(first, len(order)))
        here = label[order][first]
        first, n, here = first[n >= least], n[n >= least], here[n >= least]
        center, span = [], []
        for v in xyz.T:
            v = v[np.lexsort((v, label))]
            center.append((_quantile(v, first, n, p) + _quantile(v, first, n, q)) / 2)
            span.append(v[first + n - 1] - v[first])
        rows = t.select([*keys, row]).take(pa.array(here))
        return pa.table([*rows.columns, *map(pa.array, (n, *center, np.maximum(span[0], span[1]), span[2]))], [*keys, "label", "n", "cx", "cy", "cz", "hspan", "vspan"])

    schema = ", ".join(f"{c} {types[c]}" for c in keys) + f", label {types[row]}, n long, cx double, cy double, cz double, hspan double, vspan double"
    return _by_group(points, keys, row, measured, schema)


def kept_measurements(points: DataFrame, keeps: Sequence[str], keys: Sequence[str], row: str) -> DataFrame:
    """A row for each group and each boolean column of ``keeps`` (its name as ``keep``): n of the points that it keeps, their robust centre and spans, null without any.

    Each point is there once, whatever the number of columns; a group's points are in one task.
    """
    types = dict(points.dtypes)
    p, q = M.CENTER_QUANTILES
    names = [*keys, "keep", "n", "cx", "cy", "cz", "hspan", "vspan"]

    def measured(t: pa.Table, start: np.ndarray) -> pa.Table:
        xyz, groups = _xyz(t), np.repeat(np.arange(len(start)), np.diff(np.append(start, t.num_rows)))
        heads, parts = t.select(list(keys)).take(pa.array(start)), []
        for keep in keeps:
            kept = t.column(keep).to_numpy().astype(bool)
            g = groups[kept]
            n = np.bincount(g, minlength=len(start))
            some = n > 0
            first, m = (np.cumsum(n) - n)[some], n[some]
            center, span = np.zeros((3, len(start))), np.zeros((3, len(start)))
            for c, v in enumerate(xyz[kept].T):
                v = v[np.lexsort((v, g))]
                center[c, some] = (_quantile(v, first, m, p) + _quantile(v, first, m, q)) / 2
                span[c, some] = v[first + m - 1] - v[first]
            numbers = [pa.array(x, mask=~some) for x in (*center, np.maximum(span[0], span[1]), span[2])]
            parts.append(pa.table([*heads.columns, pa.array([keep] * len(start)), pa.array(n), *numbers], names))
        return pa.concat_tables(parts)

    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", keep string, n long, cx double, cy double, cz double, hspan double, vspan double"
    return _by_group(points, keys, row, measured, schema, keeps)


def components(labelled: DataFrame, keys: Sequence[str] = ("frame", "det"), least: int = M.MIN_COMPONENT_POINTS) -> DataFrame:
    """One row per component of enough points: n, robust centre, spans."""
    from fusegrid.operators.aggregates import robust_center, span

    g = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), *[robust_center(c).alias(f"c{c}") for c in "xyz"], F.greatest(span("x"), span("y")).alias("hspan"), span("z").alias("vspan"))
    return g.where(F.col("n") >= least)
