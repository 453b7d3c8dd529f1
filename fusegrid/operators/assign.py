"""Optimal one-to-one assignment in groups."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solve(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of a minimum-cost assignment of a finite rectangular matrix.

    Shortest augmenting paths over dual prices, one row at a time, in O(rows**2 * columns).
    """
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.zeros(0, int), np.zeros(0, int)
    if not np.isfinite(cost).all():
        raise ValueError("costs must be finite")
    if cost.shape[0] > cost.shape[1]:
        c, r = solve(cost.T)
        order = np.argsort(r, kind="stable")
        return r[order], c[order]
    n, m = cost.shape
    price_r, price_c, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        best, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, reach, end, via = row, 0.0, -1, -1
        while end < 0:
            slack = reach + cost[i] - price_r[i] - price_c
            closer = ~done & (slack < best - 1e-15)
            best[closer], back[closer] = slack[closer], via
            j = int(np.argmin(np.where(done, np.inf, best)))
            reach, via = best[j], j
            done[j] = True
            if owner[j] < 0:
                end = j
            else:
                i = owner[j]
        settled = done.copy()
        settled[end] = False
        price_r[row] += reach
        price_r[owner[settled]] += reach - best[settled]
        price_c[settled] -= reach - best[settled]
        j = end
        while j >= 0:
            before = back[j]
            owner[j] = owner[before] if before >= 0 else row
            j = before
    columns = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[columns], kind="stable")
    return owner[columns][order], columns[order]


#: Matrices of up to so many rows (the shorter side) and columns are solved by trying all ways, many at once.
FEW_ROWS, FEW_COLUMNS = 4, 5


def solve_many(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, row, column) of the optimum of each of the (count, rows, columns) matrices."""
    count, n, m = costs.shape
    if n > m:
        k, c, r = solve_many(costs.transpose(0, 2, 1))
        return k, r, c
    if not np.isfinite(costs).all():
        raise ValueError("costs must be finite")
    if n <= FEW_ROWS and m <= FEW_COLUMNS:
        ways = np.array(list(itertools.permutations(range(m), n)), int).reshape(-1, n)
        total = costs[:, np.arange(n), ways].sum(2)
        columns = ways[total.argmin(1)]
        return np.repeat(np.arange(count), n), np.tile(np.arange(n), count), columns.ravel()
    done = [solve(c) for c in costs]
    return np.repeat(np.arange(count), [len(r) for r, _ in done]), np.concatenate([r for r, _ in done]), np.concatenate([c for _, c in done])


def _starts(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The first row of each run of equal keys; nulls are equal to one another."""
    fresh = np.zeros(t.num_rows, bool)
    fresh[:1] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        a, b = c.slice(0, max(0, len(c) - 1)), c.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        fresh[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(fresh)


def _matched(t: pa.Table, keys: Sequence[str], left: str, right: str, cost: str, fill: float | None, accept: float) -> pa.Table:
    """The accepted pairs of all groups of a table in order of its keys."""
    starts = _starts(t, keys)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))

    def side(name: str):
        """(place of each row's value in its group, values a group, first place of a group, a row of each value)."""
        code = pc.rank(t.column(name).combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        _, row, place = np.unique(group * (int(code.max(initial=0)) + 1) + code, return_index=True, return_inverse=True)
        sizes = np.bincount(group[row], minlength=len(starts))
        first = np.cumsum(sizes) - sizes
        return place - first[group], sizes, first, row

    (i, n, i0, i_row), (j, m, j0, j_row) = side(left), side(right)
    value = t.column(cost).to_numpy().astype(float)
    picked: list[tuple[np.ndarray, ...]] = []
    for shape in {*zip(n.tolist(), m.tolist(), strict=True)}:
        groups = np.flatnonzero((n == shape[0]) & (m == shape[1]))
        place = np.full(len(starts), -1)
        place[groups] = np.arange(len(groups))
        rows = np.flatnonzero((place[group] >= 0) & np.isfinite(value))
        costs = np.full((len(groups), *shape), np.nan if fill is None else fill)
        costs[place[group[rows]], i[rows], j[rows]] = value[rows]
        k, r, c = solve_many(costs)
        ok = costs[k, r, c] <= accept
        k, r, c = k[ok], r[ok], c[ok]
        g = groups[k]
        picked.append((starts[g], i_row[i0[g] + r], j_row[j0[g] + c], costs[k, r, c]))
    g, a, b, d = (np.concatenate(x) for x in zip(*picked, strict=True)) if picked else (np.zeros(0, int),) * 3 + (np.zeros(0),)
    columns = [t.column(k).take(g) for k in keys] + [t.column(left).take(a), t.column(right).take(b), pa.array(d)]
    return pa.Table.from_arrays(columns, [*keys, left, right, cost])


def assign(pairs: DataFrame, keys: Sequence[str], left: str, right: str, cost: str, fill: float | None, accept: float) -> DataFrame:
    """(keys, left, right, cost) of the accepted pairs of each group's optimum.

    ``pairs`` has a row for each candidate pair; a pair that is absent, or of null cost, costs ``fill`` (without a fill
    all pairs must be there).  The gate comes after the optimum: pairs over ``accept`` are dropped last.
    Groups stream through a task in order, and all small ones of a batch are solved at once.
    """
    types = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            last = _starts(t, keys)[-1:] if t.num_rows else [0]
            # the last group may go on in the next batch
            yield from _matched(t.slice(0, last[0]), keys, left, right, cost, fill, accept).to_batches()
            held = t.slice(last[0]).to_batches()
        if held:
            yield from _matched(pa.Table.from_batches(held), keys, left, right, cost, fill, accept).to_batches()

    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, left, right)) + f", {cost} double"
    rows = pairs.select(*keys, left, right, F.col(cost).cast("double").alias(cost))
    return rows.repartition(*keys).sortWithinPartitions(*keys, left, right).mapInArrow(run, schema)


def with_dummies(pairs: DataFrame, keys: Sequence[str], left: str, right: str, cost: str, dummy: float) -> DataFrame:
    """The pairs plus, for each left row, a column of its own (numbered -1 - left) at the dummy cost."""
    own = pairs.select(*keys, left).distinct().withColumns({right: -1 - F.col(left), cost: F.lit(dummy)})
    return pairs.select(*keys, left, right, cost).unionByName(own.select(*keys, left, right, cost))


def full_outer_match(matched: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], l: str, r: str) -> DataFrame:  # noqa: E741
    """Matched pairs and both sides' rows without a match, with ``side``: both, left or right."""
    a = left.select(*keys, l).join(matched, [*keys, l], "left")
    b = right.select(*keys, r).join(matched.select(*keys, r), [*keys, r], "left_anti")
    out = a.withColumn("side", F.when(F.col(r).isNull(), "left").otherwise("both"))
    return out.unionByName(b.withColumn("side", F.lit("right")), allowMissingColumns=True)
