"""Connected components by alternating large-star and small-star steps.

Every step is one map-side combined ``min`` and one equi-join, so no node's
neighbourhood is ever gathered in one task and a hub with a third of all edges
only makes a skewed join, which AQE splits; the least neighbours of a graph of few edges
are broadcast.  Of integer ids each task puts a spanning forest, of the same components,
in the place of its edges, as stars around least ids, at first and after each round.  Each round is written to the shared
folder, in files of PER_FILE edges at most where they are fewer than the partitions; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.operators.cluster import _joined
from fusegrid.plans.scratch import discard, materialize

#: Edges whose nodes may be broadcast.
BROADCAST_EDGES = 200_000
#: Edges that a task puts a forest in the place of at once, and edges of a file.
FOREST, PER_FILE = 1 << 18, 1 << 16


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of a stretch of edges but the least of its component, and that least one."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([b.column(c).to_numpy() for c in ("u", "v") for b in held])
        ids, at = np.unique(ends, return_inverse=True)
        label = _joined(np.arange(len(ids)), at[: len(at) // 2], at[len(at) // 2 :])
        hung = label < np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[hung]), pa.array(ids[label[hung]])], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= FOREST:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One step over canonical edges (u > v): hook each node's neighbours to its least neighbour."""
    pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hooked = pairs.join(F.broadcast(low) if few else low, "u")
    hooked = hooked.where("v > u").select("v", "m") if large else hooked.select("v", "m").union(low.select(F.col("u").alias("v"), "m"))
    hooked = hooked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # the small star bears repeated edges, which only cost the join that shuffles them
    return hooked if large and few else hooked.distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """(edges, nodes that do not hang on one root alone)."""
    ends = edges.select(F.col("u").alias("id"), "v").union(edges.select(F.col("v").alias("id"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    of = ends.groupBy("id").agg(F.count("v").alias("up"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    n, open_ = of.agg(F.sum("up"), F.count_if(F.expr("up > 0 and (up < n or low <> high)"))).first()
    return n or 0, open_


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b) of an orderable id type -> (id, component): the least id reachable, for ids that have an edge.

    Null ends and loops are ignored; repeated and reversed edges count once; an
    empty input gives an empty result.  Raises if ``max_rounds`` do not suffice.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    forest = (lambda d: d.mapInArrow(_forest, d.schema)) if dict(e.dtypes)["u"] == "bigint" else (lambda d: d)
    e = materialize(forest(e), "cc")
    n, open_ = _state(e)
    for _ in range(max_rounds):
        if not open_:
            break
        few = n <= BROADCAST_EDGES
        before, e = e, materialize(forest(_star(_star(e, True, few), False, few).coalesce(n // PER_FILE + 1)), "cc")
        n, open_ = _state(e)
        discard(before)
    if open_:
        raise RuntimeError("connected components did not converge")
    ends = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return ends.distinct().coalesce(n // PER_FILE + 1)
