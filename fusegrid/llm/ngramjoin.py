"""Jaccard join of documents on word n-grams by a count-vector R-tree.

A document's shingles are hashed into ``DIMENSIONS`` groups; the group counts are its
point.  The overlap of two sets is at most the sum of the smaller counts of each
group, and that of two boxes of points at most the sum of the smaller upper corners,
which prunes pairs of tree nodes and then pairs of points; the rest are verified on the
shingles.  One tree over all points would prune little, as boxes in so many dimensions
overlap; so the points are first dealt into blocks of sets that share a whole group of
shingles (``setjoin``: no pair over the threshold is lost), and each block has its tree.
Pairs already connected, over verified links to the pivots of their blocks, are not
searched again, so a group of n near copies costs about n verifications.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.bitmaps import filter_of, held
from fusegrid.llm.setjoin import BROADCAST_IDS, Threshold, blocks, chunks, differing, fingerprints, keys, semi, short, sketches, verified
from fusegrid.llm.words import buffers, mix, pack, shingles_of, words_of
from fusegrid.plans.components import BROADCAST_EDGES, connected_components
from fusegrid.plans.scratch import discard, materialize

WIDTH, THRESHOLD = 5, Threshold(4, 5)
DIMENSIONS, LEAF, FANOUT, PIVOTS = 64, 16, 8, 2
#: Pairs of nodes that are taken down at once.
NODES = 512
#: Least number of cells of the parities that go with a point into the search; large sets have about twice as many cells as elements, as fewer would be full.
CELLS = 1024
#: Pairs whose parities are compared at once.
COMPARED = 4096
#: Members of a block that one task holds; larger blocks are searched by pairs of chunks.
CHUNK = 2048


def _sets(batch: pa.RecordBatch, width: int):
    """Fingerprints, sizes and shingles of a slice's texts (column 1)."""
    data, offsets = buffers(batch.column(1))
    h, _, row = words_of(data, offsets, lower=True)
    elements, _, n = shingles_of(h, row, batch.num_rows, width)
    return fingerprints(elements, n), n, elements


def points(elements: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Group counts (sets, DIMENSIONS)."""
    row = np.repeat(np.arange(len(n)), n)
    group = (mix(elements ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.bincount(row * DIMENSIONS + group, minlength=len(n) * DIMENSIONS).reshape(len(n), DIMENSIONS).astype(np.int32)


def _needed(t: Threshold, total: np.ndarray) -> np.ndarray:
    """The least overlap that sets of ``total`` elements together must have."""
    return -(-t.num * total // (t.num + t.den))


def _squeezed(elements: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Sorted sets as their steps in planes of bytes, the high ones of which are mostly 0, compressed."""
    step = elements.copy()
    step[1:] -= elements[:-1]
    starts = np.cumsum(n) - n
    step[starts[n > 0]] = elements[starts[n > 0]]
    planes = step.view(np.uint8).reshape(-1, 8)
    return [int(k).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes[a : a + k].T).tobytes(), codec="zstd", asbytes=True) for a, k in zip(starts.tolist(), n.tolist(), strict=True)]


def _unsqueezed(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


class Tree:
    """A packed R-tree over points of labelled sets.

    A level has the first and last child, least size, upper corner, and least and greatest label of each node.
    """

    def __init__(self, x: np.ndarray, label: np.ndarray | None = None):
        self.order = self._tiled(x, np.arange(len(x)), 0)
        self.x = x[self.order]
        self.n = self.x.sum(1)
        self.label = np.arange(len(x)) if label is None else label[self.order]
        level, count = (None, None, self.n, self.x, self.label, self.label), len(x)
        self.levels = []
        for fan in (LEAF, *[FANOUT] * 64):
            starts = np.arange(0, count, fan)
            level = (starts, np.minimum(starts + fan, count), np.minimum.reduceat(level[2], starts), np.maximum.reduceat(level[3], starts), np.minimum.reduceat(level[4], starts), np.maximum.reduceat(level[5], starts))
            self.levels.append(level)
            count = len(starts)
            if count == 1:
                break

    @staticmethod
    def _tiled(x: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        """Rows in tiles of LEAF: split at the median of the size first, then of the widest dimension."""
        if len(rows) <= LEAF:
            return rows
        by = x[rows].sum(1) if depth == 0 else x[rows][:, np.argmax(np.ptp(x[rows], 0))]
        rows = rows[np.argsort(by, kind="stable")]
        half = -(-len(rows) // 2 // LEAF) * LEAF or LEAF
        return np.concatenate((Tree._tiled(x, rows[:half], depth + 1), Tree._tiled(x, rows[half:], depth + 1)))


def _children(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """All pairs (i, j) with i in a0:a1 and j in b0:b1, row by row."""
    wide, count = b1 - b0, (a1 - a0) * (b1 - b0)
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    return np.stack((a0[row] + k // wide[row], b0[row] + k % wide[row]), 1)


def tree_pairs(t: Threshold, one: Tree, other: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of one, row of other) for all pairs of different labels whose points allow the threshold, by descending both trees."""
    level = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]

    def descend(k: int, pairs: np.ndarray):
        a, b = level(one, k), level(other, k)
        i, j = pairs[:, 0], pairs[:, 1]
        ok = ~((a[4][i] == a[5][i]) & (a[4][i] == b[4][j]) & (a[4][i] == b[5][j]))
        if one is other:
            ok &= i <= j
        i, j = i[ok], j[ok]
        ok = np.minimum(a[3][i], b[3][j]).sum(1) >= _needed(t, a[2][i] + b[2][j])
        i, j = i[ok], j[ok]
        if k:
            down = [(x[0][r], x[1][r]) if k < len(tree.levels) else (r, r + 1) for tree, x, r in ((one, a, i), (other, b, j))]
            for s in range(0, len(i), NODES):
                yield from descend(k - 1, _children(*(c[s : s + NODES] for side in down for c in side)))
            return
        for s in range(0, len(i), NODES):
            r = _children(a[0][i[s : s + NODES]], a[1][i[s : s + NODES]], b[0][j[s : s + NODES]], b[1][j[s : s + NODES]])
            p, q = r[:, 0], r[:, 1]
            ok = (one.label[p] != other.label[q]) & t.sizes_fit(one.n[p], other.n[q])
            p, q = p[ok], q[ok]
            ok = np.minimum(one.x[p], other.x[q]).sum(1) >= _needed(t, one.n[p] + other.n[q])
            yield one.order[p[ok]], other.order[q[ok]]

    yield from descend(max(len(one.levels), len(other.levels)) - 1, np.zeros((1, 2), np.int64))


def _bounded(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (y, x) whose sketches, of sets (id, n, sketch), admit the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n, p, q = (b.column(c).to_pylist() for c in ("m", "n", "p", "q"))
            ok = [differing(u, v) * (t.num + t.den) <= (i + j) * (t.den - t.num) for i, j, u, v in zip(m, n, p, q, strict=True)]
            yield b.select(["y", "x"]).filter(pa.array(ok, pa.bool_()))

    y, x = (sets.select(F.col("id").alias(c), F.col("n").alias(k), F.col("sketch").alias(s)) for c, k, s in (("y", "m", "p"), ("x", "n", "q")))
    return pairs.join(y, "y").join(x, "x").select("y", "x", "m", "n", "p", "q").mapInArrow(run, "y long, x long")


class Parities:
    """Sketches of several sizes, compared at the smaller size of a pair."""

    def __init__(self, sketches: list[bytes]):
        self.held = [np.frombuffer(v, np.uint64) for v in sketches]
        self.words = np.array([len(v) for v in self.held])
        self.folded: dict[int, np.ndarray] = {}

    def _at(self, words: int) -> np.ndarray:
        """All sketches of so many words or more, brought to so many."""
        if words not in self.folded:
            out = np.zeros((len(self.held), words), np.uint64)
            for size in np.unique(self.words[self.words >= words]):
                rows = np.flatnonzero(self.words == size)
                m = np.stack([self.held[r] for r in rows])
                while m.shape[1] > words:
                    m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
                out[rows] = m
            self.folded[words] = out
        return self.folded[words]

    def differing(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """For each pair the parities in which it differs, at most the number of elements that only one set has."""
        least, out = np.minimum(self.words[r], self.words[s]), np.zeros(len(r), np.int64)
        for words in np.unique(least):
            m, which = self._at(int(words)), np.flatnonzero(least == words)
            for a in range(0, len(which), COMPARED):
                w = which[a : a + COMPARED]
                out[w] = np.bitwise_count(m[r[w]] ^ m[s[w]]).sum(1, dtype=np.int64)
        return out


def _search(members: DataFrame, t: Threshold) -> DataFrame:
    """Unconnected pairs (y, x) of a block that the trees' bound and the parities admit.

    members: block, m, id, component, point, sketch.  Blocks of more than CHUNK members are searched by pairs of parts.
    """
    parts = F.ceil(F.col("m") / CHUNK).cast("int")
    w = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    w = w.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    w = w.withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o")}).drop("o", "parts", "m")

    def one(g: pa.Table) -> pa.Table:
        ids, component, part = (g.column(c).to_numpy() for c in ("id", "component", "part"))
        x = np.frombuffer(b"".join(g.column("point").to_pylist()), np.int32).reshape(-1, DIMENSIONS)
        n, parities = x.sum(1), Parities(g.column("sketch").to_pylist())
        sides = [np.flatnonzero(part == k) for k in dict.fromkeys(g.column(c)[0].as_py() for c in ("i", "j"))]
        out = []
        if all(len(s) for s in sides):
            trees = [Tree(x[s], component[s]) for s in sides]
            for r, s in tree_pairs(t, trees[0], trees[-1]):
                r, s = sides[0][r], sides[-1][s]
                ok = parities.differing(r, s) * (t.num + t.den) <= (n[r] + n[s]) * (t.den - t.num)
                if ok.any():
                    out.append(np.stack((ids[r[ok]], ids[s[ok]]), 1))
        got = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table({"y": got.max(1, initial=-(2**63)), "x": got.min(1, initial=2**63 - 1)})

    return w.groupBy("block", "i", "j").applyInArrow(one, "y long, x long").distinct()


def _joined(docs: DataFrame, width: int, threshold: Threshold) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``join``, and the tables that it is read from."""
    t = threshold
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            ids, n, elements = _sets(part, width)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids), pa.array(n.astype(np.int64)), pack(points(elements, n).ravel(), np.full(len(n), DIMENSIONS)).cast(pa.binary()), pa.array(sketches(elements, n, least=CELLS), pa.binary())], ["doc_id", "id", "n", "point", "sketch"])

    scratch = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        scratch.append(materialize(df, tag))
        return scratch[-1]

    outlines = kept(source.mapInArrow(outline, "doc_id long, id long, n long, point binary, sketch binary"), "outlines")
    met = blocks(source, lambda b: keys(t, *_sets(b, width)))
    shorts = kept(met.select("short").distinct(), "shorts")
    known = semi(outlines.withColumn("short", short(F.col("id"))), shorts, "short")
    known = kept(known.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("sketch").alias("sketch")), "known")

    # a text of null ids only is fetched under a stand-in
    stand_in = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")
    n_known = known.count()
    wanted = filter_of(known.select("id", stand_in), n_known)
    by_document = filter_of(known.select(stand_in), n_known)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            part = part.filter(pa.array(held(by_document, part.column(0).to_numpy())))
            ids, n, elements = _sets(part, width)
            ok = held(wanted, ids, part.column(0).to_numpy())
            elements, n = elements[np.repeat(ok, n)], n[ok]
            columns = [pa.array(ids[ok]), pa.array(n), pa.array(_squeezed(elements, n), pa.binary()), pa.array(sketches(elements, n), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "elements", "sketch"])

    # rows that repeat an id and a text give a set more than once, which the joins bear
    sets = kept(source.select(stand_in, "text").mapInArrow(whole, "id long, n long, elements binary, sketch binary"), "sets")

    links, tried, component = None, None, None
    members = kept(met.join(known.select("id", "n", short(F.col("id")).alias("short")), "short").drop("short"), "members")
    for round_ in range(PIVOTS + 1):
        if component is not None:
            labelled = members.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
        else:
            labelled = members.withColumn("component", F.col("id"))
        # blocks that hold two components or more, and their pivots
        pivot = labelled.groupBy("block").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), *([] if round_ == PIVOTS else [F.min(F.struct(F.xxhash64("id", F.lit(round_)).alias("h"), F.col("id").alias("p"), F.col("component").alias("pc"), F.col("n").alias("pn"))).alias("v")]))
        open_ = labelled.join(pivot.where("c1 <> c2").drop("c1", "c2"), "block")
        if round_ < PIVOTS:
            pairs = open_.where((F.col("id") != F.col("v.p")) & (F.col("component") != F.col("v.pc")) & t.sizes_fit(F.col("n"), F.col("v.pn")))
            pairs = pairs.select(F.greatest("id", "v.p").alias("y"), F.least("id", "v.p").alias("x")).distinct()
        else:
            pairs = _search(open_.join(known.select("id", "point", "sketch"), "id").select("block", "m", "id", "component", "point", "sketch"), t)
        if tried is not None:
            pairs = pairs.join(tried, ["y", "x"], "left_anti")
        pairs = kept(_bounded(pairs, sets, t).distinct(), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        new = kept(verified(pairs, sets.select("id", "elements"), t, _unsqueezed).select(F.col("y").alias("a"), F.col("x").alias("b")), "links")
        links = new if links is None else links.union(new)
        component = kept(connected_components(links), "component")
        component = F.broadcast(component) if component.count() <= BROADCAST_EDGES else component

    # null ids are kept apart by a name of their own
    c = outlines.select("doc_id", "id", "n").join(component, "id", "left").withColumn("c", F.coalesce("component", "id"))
    least = c.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = c.join(least, "c", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out, scratch


def join(docs: DataFrame, width: int = WIDTH, threshold: Threshold = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document.

    Words are lower-cased (A-Z) and cut at ASCII white space; a text with fewer words
    than ``width`` is one shingle; without words or text the set is empty, links with
    nothing, and the document is its own component.  Null ids never name a
    component that has others; rows that repeat an id are documents of one name;
    an empty table gives an empty result; other columns are not read.  Sets are compared
    by 64-bit hashes of their shingles and named by 64-bit fingerprints.
    """
    return _joined(docs, width, threshold)[0]


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents, unchanged, without all but the least id of each group of linked ones.

    Documents without words and those of a null id stay; rows that repeat an id share its fate.
    """
    found, scratch = _joined(docs, options.get("width", WIDTH), options.get("threshold", THRESHOLD))
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    discard(*scratch)
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, "doc_id", "left_anti")
