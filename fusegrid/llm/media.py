"""Copies among images by local descriptors.

Corners are found at several scales; around each, binary intensity tests in a frame
turned by the patch's orientation give a 256-bit descriptor.  Descriptors meet in eight
Hamming tables, one for each two neighbouring words of 32 bits: two that differ in three bits
or fewer share such 64 bits for certain, and most copies' do.  In each table cell (the packed blocks of ``setjoin``) the images are matched with two pivots of the
cell, not with one another, so a word that very many images have costs one pair an
image; then the images that are not yet connected are compared with one another if enough
corners match, alike in scale and turn, in cells of the rare prefix of both (``rare_cells``: exact).
Parts of images meet for that, read from files that are written once, so matches are counted and
pairs of images compared where they are found, and no image is sent or stored more than once.  A match votes for the similarity transform that it implies, and a pair of
images with enough votes for one transform is a copy, cropped or edited.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusegrid.llm.setjoin import BROADCAST_IDS, SALT_ROWS, blocks, short
from fusegrid.llm.words import mix
from fusegrid.plans.components import connected_components
from fusegrid.plans.scratch import discard, materialize

SCALES = (1.0, 1.5, 2.25)
CORNERS, RADIUS, TESTS, WORDS = 12, 11, 256, 8
#: A match differs in this many bits at most; a copy has this many distinct corners voting for one transform.
BITS, VOTES, CELL = 40, 6, 8.0
#: Matched corners that the candidate search asks for; corners of an image are numbered below 63.
SHARED = 3
#: Only cells of more descriptors get pivots; in smaller ones the search has little to compare.
PIVOTED = 16
#: Images of a part; a task searches one part, or one against another.  Files of a part at most, and searches of a job.
CHUNK, FILES, SEARCHES = 1 << 14, 32, 48
#: Pairs of descriptors that are compared at once, and after which what was found is counted.
PAIRS, STEP = 1 << 17, 1 << 20
UNION = "spark.sql.unionOutputPartitioning"
SCHEMA = "id long, words binary, image_id long, x float, y float, scale float, angle float"
KINDS = (pa.int64(), pa.binary(), pa.int64(), pa.float32(), pa.float32(), pa.float32(), pa.float32())


def decode(blob: bytes) -> np.ndarray | None:
    """Grey levels (rows, columns) of a binary PGM or PPM, or of an 8-bit PNG that is not interlaced; else None."""
    try:
        if blob[:2] in (b"P5", b"P6"):
            head, rest = [], blob
            while len(head) < 4:
                line, rest = rest.split(b"\n", 1)
                head += line.split(b"#")[0].split()
            w, h, n = int(head[1]), int(head[2]), 3 if head[0] == b"P6" else 1
            a = np.frombuffer(rest, np.uint8, w * h * n).reshape(h, w, n)
        elif blob[:8] == b"\x89PNG\r\n\x1a\n":
            a = _png(blob)
        else:
            return None
        return a[..., : min(3, a.shape[2])].mean(2).astype(np.float32) if a.shape[2] > 2 else a[..., 0].astype(np.float32)
    except (ValueError, IndexError, KeyError, zlib.error):
        return None


def _png(blob: bytes) -> np.ndarray:
    at, data, w, h, n = 8, [], 0, 0, 0
    while at < len(blob):
        size, kind = int.from_bytes(blob[at : at + 4]), blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h = int.from_bytes(body[:4]), int.from_bytes(body[4:8])
            n = {0: 1, 2: 3, 4: 2, 6: 4}[body[9]]
            if body[8] != 8 or body[12]:
                raise ValueError("depth or interlacing")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w + 1, n), np.int32)
    for r in range(h):
        kind, line = raw[r, 0], raw[r, 1:].reshape(w, n)
        for c in range(w):
            a, b, d = out[r + 1, c], out[r, c + 1], out[r, c]
            p = a + b - d
            paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - d)), a, np.where(abs(p - b) <= abs(p - d), b, d))
            out[r + 1, c + 1] = (line[c] + (0, a, b, (a + b) // 2, paeth)[kind]) & 255
    return out[1:, 1:].astype(np.uint8)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over windows of side 2r+1, with edges repeated."""
    p = np.pad(a, r + 1, mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (p[n:-1, n:-1] - p[: -n - 1, n:-1] - p[n:-1, : -n - 1] + p[: -n - 1, : -n - 1]) / (n * n)


def _shrunk(a: np.ndarray, s: float) -> np.ndarray:
    if s == 1:
        return a
    h, w = int(a.shape[0] / s), int(a.shape[1] / s)
    y, x = (np.arange(h) + 0.5) * s - 0.5, (np.arange(w) + 0.5) * s - 0.5
    y0, x0 = np.floor(y).astype(int).clip(0), np.floor(x).astype(int).clip(0)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (a[y0][:, x0] * (1 - fy) + a[y1][:, x0] * fy) * (1 - fx) + (a[y0][:, x1] * (1 - fy) + a[y1][:, x1] * fy) * fx


@lru_cache(maxsize=1)
def _pattern() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test points (TESTS, 2 ends, 2) within the radius, and the disc of the orientation moment."""
    rng = np.random.default_rng(11)
    angle, r = rng.uniform(0, 2 * np.pi, (TESTS, 2)), (RADIUS - 1) * np.sqrt(rng.uniform(0, 1, (TESTS, 2)))
    yy, xx = np.mgrid[-7:8, -7:8]
    inside = yy**2 + xx**2 <= 49
    return np.stack((r * np.cos(angle), r * np.sin(angle)), -1), yy[inside], xx[inside]


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners: x, y, scale, angle in the image's own pixels; descriptors as (n, WORDS) int32)."""
    points, dy, dx = _pattern()
    corners, words = [], []
    for s in SCALES:
        a = _box(_shrunk(image, s), 1)
        if min(a.shape) <= 2 * RADIUS + 4:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        near = np.lib.stride_tricks.sliding_window_view(np.pad(response, 2, constant_values=-np.inf), (5, 5)).max((2, 3))
        response = np.where(response >= near, response, 0)
        edge = RADIUS + 1
        response[:edge] = response[-edge:] = 0
        response[:, :edge] = response[:, -edge:] = 0
        best = np.argsort(-response.ravel(), kind="stable")[:CORNERS]
        best = best[response.ravel()[best] > 1.0]
        if not len(best):
            continue
        y, x = np.divmod(best, a.shape[1])
        patch = a[y[:, None] + dy, x[:, None] + dx]
        angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
        c, si = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(x[:, None, None] + points[..., 0] * c - points[..., 1] * si).astype(int)
        py = np.rint(y[:, None, None] + points[..., 0] * si + points[..., 1] * c).astype(int)
        v = a[py, px]
        bits = v[..., 0] < v[..., 1]
        words.append(np.packbits(bits, 1).view(">i4").astype(np.int32))
        corners.append(np.stack(((x + 0.5) * s, (y + 0.5) * s, np.full(len(x), s), angle), 1))
    return (np.concatenate(corners), np.concatenate(words)) if corners else (np.zeros((0, 4)), np.zeros((0, WORDS), np.int32))


def described(images: DataFrame) -> DataFrame:
    """One row per corner of each image (image_id, image: encoded bytes), ``id`` is 256 * image_id + corner; and one row per image, without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            # every image has a row, so the images themselves are read once
            rows = [pa.nulls(b.num_rows, k) for k in KINDS]
            rows[names.index("image_id")] = b.column(0)
            yield pa.RecordBatch.from_arrays(rows, names)
            for image_id, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = decode(blob) if blob and image_id is not None else None
                corners, words = describe(a) if a is not None else ((), ())
                if len(corners):
                    of = {"id": image_id * 256 + np.arange(len(corners)), "words": [w.tobytes() for w in words], "image_id": np.full(len(corners), image_id), "x": corners[:, 0], "y": corners[:, 1], "scale": corners[:, 2], "angle": corners[:, 3]}
                    yield pa.RecordBatch.from_arrays([pa.array(of[n], k) for n, k in zip(names, KINDS, strict=True)], names)

    return images.select(F.col("image_id").cast("long").alias("image_id"), "image").mapInArrow(run, SCHEMA)


def descriptors(images: DataFrame) -> DataFrame:
    """The corners alone."""
    return described(images).where("id is not null")


def _cells(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A key for each table of each descriptor: the table's number and its two words."""
    words = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, WORDS).astype(np.uint64)
    both = words | np.roll(words, -1, 1) << np.uint64(32)
    keys = mix(mix(both) + np.arange(1, WORDS + 1, dtype=np.uint64))
    return keys.ravel(), np.repeat(part.column(0).to_numpy(), WORDS)


def _image(id_: str) -> Column:
    """The image of a descriptor; a shift, as a quotient of large ids would be rounded."""
    return F.shiftright(id_, 8)


def cells(found: DataFrame) -> DataFrame:
    """(block, id, m): the m descriptors of each table cell that two or more share."""
    ids = found.select("id", short(F.col("id")).alias("short"))
    met = blocks(found.select("id", "words"), _cells)
    out = materialize(met.join(ids, "short").select("block", "id", "m"), "cells")
    discard(met)
    return out


def pivot_pairs(met: DataFrame) -> DataFrame:
    """(id_f, id_g, _a, _b: their images): descriptors with those of two pivot images of their cells, for images with VOTES such pairs.

    Images with fewer pairs cannot have the matches of a copy, and cells of up to PIVOTED descriptors have no pivots.
    """
    met = met.where(F.col("m") > PIVOTED)
    first = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), _image("id")).alias("h"), F.col("id").alias("p")))["p"]
    pivots = met.groupBy("block").agg(F.array_distinct(F.array(first(0), first(1))).alias("pivots"))
    pairs = met.join(pivots, "block").select("id", F.explode("pivots").alias("p")).where(_image("id") != _image("p"))
    pairs = pairs.select(F.greatest("id", "p").alias("f"), F.least("id", "p").alias("g"))
    # both corners in one number, as what is gathered for a pair of images is small
    pairs = pairs.select(_image("f").alias("_a"), _image("g").alias("_b"), (F.pmod("f", F.lit(256)) * 256 + F.pmod("g", F.lit(256))).cast("int").alias("c"))
    pairs = pairs.repartition("_a", "_b").groupBy("_a", "_b").agg(F.collect_set("c").alias("c")).where(F.size("c") >= VOTES)
    pairs = pairs.select("_a", "_b", F.explode("c").alias("c"))
    id_ = lambda image, corner: F.shiftleft(image, 8) + corner
    return materialize(pairs.select(id_("_a", F.shiftright("c", 8)).alias("id_f"), id_("_b", F.pmod("c", F.lit(256))).alias("id_g"), "_a", "_b"), "matches")


def matches(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, id_f, id_g and both corners' frames): the pairs of descriptors within BITS."""
    pairs = pairs.select("id_f", "id_g")
    named = materialize(pairs.select(F.explode(F.array("id_f", "id_g")).alias("id")).distinct(), "named")
    if named.count() <= BROADCAST_IDS:  # most corners are in no pair, and need not be sent
        found = found.join(F.broadcast(named), "id", "left_semi")
    side = lambda s: found.select(F.col("id").alias(f"id_{s}"), F.col("image_id").alias("ab"["fg".index(s)]), F.col("words").alias(f"words_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("x", "y", "scale", "angle")])
    m = pairs.join(side("f"), "id_f").join(side("g"), "id_g")
    word = lambda s, i: F.conv(F.hex(F.substring(f"words_{s}", 8 * i + 1, 8)), 16, -10).cast("long")
    far = sum((F.bit_count(word("f", i).bitwiseXOR(word("g", i))) for i in range(WORDS // 2)), F.lit(0))
    return m.where(far <= BITS).drop("words_f", "words_g")


def _steps(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` partners together, or of one row."""
    done, at = np.concatenate(([0], np.cumsum(count))), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(done, done[at] + most, "right")) - 1)
        yield at, to
        at = to


class _Side:
    """The corners of some images in their cells, in order of the images: cell, image and descriptor of each."""

    def __init__(self, g: pa.Table):
        flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in g.column(c).chunks] or [np.zeros(0, np.int64)])
        each = lambda c: np.repeat(np.arange(g.num_rows), pc.list_value_length(g.column(c)).to_numpy())
        self.ids, self.component = g.column("image_id").to_numpy(), g.column("component").to_numpy()
        self.corner, self.scale, self.angle = flat("corners").astype(np.int64), flat("scale"), flat("angle")
        #: Descriptors of each image, and the first of them.
        self.many = pc.list_value_length(g.column("corners")).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.many) - self.many
        self.words = np.frombuffer(b"".join(g.column("words").to_pylist()), np.uint64).reshape(-1, WORDS // 2)
        # the descriptors of a corner: one, but where rows repeat an image's id; numbers of 32 bits, as there are many
        own, image = (each("corners") * 256 + self.corner).astype(np.int32), each("blocks").astype(np.int32)
        want = image * np.int32(256) + flat("at").astype(np.int32)
        first = np.searchsorted(own, want).astype(np.int32)
        many = np.searchsorted(own, want, "right").astype(np.int32) - first
        of = np.repeat(np.arange(len(want), dtype=np.int32), many)
        self.block, self.image = flat("blocks")[of], image[of]
        self.row = first[of] + np.arange(len(of), dtype=np.int32) - (np.cumsum(many, dtype=np.int32) - many)[of]

    def only(self, rows: np.ndarray) -> None:
        self.block, self.image, self.row = self.block[rows], self.image[rows], self.row[rows]


def _bins(one: _Side, other: _Side, f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The step of scale and turn, below 256, of each match of descriptors f and g."""
    turn = np.rint((other.angle[g] - one.angle[f]).astype(np.float64) * (12 / (2 * np.pi))) % 12
    return (12 * (8 + np.rint(np.log2(other.scale[g] / one.scale[f]) * 4)) + turn).astype(np.int64)


def _with_corners(key: np.ndarray, corner: np.ndarray, least: int) -> np.ndarray:
    """The keys that have so many different corners."""
    which, n = np.unique(np.unique(key * 64 + corner) >> 6, return_counts=True)
    return which[n >= least]


def _agreeing(one: _Side, other: _Side, alike: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of images of two sides, by place, of different components and with SHARED corners of either matched."""
    blocks, names = np.unique(other.block), np.unique(np.concatenate((one.component, other.component)))
    if one is not other:
        one.only(blocks[np.minimum(np.searchsorted(blocks, one.block), len(blocks) - 1)] == one.block if len(blocks) else np.zeros(len(one.block), bool))
    key, sought = (np.searchsorted(blocks, x.block) << 32 | np.searchsorted(names, x.component)[x.image] for x in (other, one))
    order = np.argsort(key, kind="stable")
    key, cell = key[order], sought >> 32 << 32
    # the partners of a row: those of its cell before its component, and behind it too if the sides are two
    spans = [(np.searchsorted(key, cell), np.searchsorted(key, sought))]
    if one is not other:
        spans.append((np.searchsorted(key, sought, "right"), np.searchsorted(key, cell + (1 << 32))))
    counts = [high - low for low, high in spans]
    ends = np.searchsorted(one.image, np.arange(len(one.ids) + 1))
    partners = np.concatenate(([0], np.cumsum(sum(counts))))
    for i, j in _steps(np.diff(partners[ends]), STEP):
        found = []
        for (low, _), count in zip(spans, counts, strict=True):
            for p, q in _steps(count[ends[i] : ends[j]], PAIRS):
                p, q = p + ends[i], q + ends[i]
                r = np.repeat(np.arange(p, q), count[p:q])
                s = order[low[r] + np.arange(len(r)) - (np.cumsum(count[p:q]) - count[p:q])[r - p]]
                ok = np.bitwise_count(one.words[one.row[r]] ^ other.words[other.row[s]]).sum(1) <= BITS
                found.append((r[ok], s[ok]))
        if not found:
            continue
        r, s = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        f, g = one.row[r], other.row[s]
        pair = one.image[r].astype(np.int64) * len(other.ids) + other.image[s]
        if alike:
            pair = pair * 256 + _bins(one, other, f, g)
        enough = [_with_corners(pair, corner, SHARED) for corner in (one.corner[f], other.corner[g])]
        pair = np.unique(np.concatenate(enough) // (256 if alike else 1))
        yield pair // len(other.ids), pair % len(other.ids)


def _compared(one: _Side, other: _Side, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id_f, id_g): the matches, in any cell, of images x of one side with y of the other, of which VOTES corners of each match alike."""
    for p, q in _steps(one.many[x] * other.many[y], PAIRS):
        count = one.many[x[p:q]] * other.many[y[p:q]]
        pair = np.repeat(np.arange(p, q), count)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        f, g = one.start[x[pair]] + k // other.many[y[pair]], other.start[y[pair]] + k % other.many[y[pair]]
        differ = one.words[f] ^ other.words[g]
        near = np.bitwise_count(differ).sum(1) <= BITS
        pair, f, g, same = pair[near], f[near], g[near], differ[near].view(np.uint32) == 0
        match = (pair * 256 + one.corner[f]) * 256 + other.corner[g]
        # a corner has several descriptors where rows repeat an image's id
        met = np.isin(match, match[(same & np.roll(same, -1, 1)).any(1)])
        key = pair * 256 + _bins(one, other, f, g)
        enough = [_with_corners(key[met], corner[met], VOTES) for corner in (one.corner[f], other.corner[g])]
        match = np.unique(match[met & np.isin(key, np.intersect1d(*enough))])
        a, b = one.ids[x[match >> 16]] * 256 + (match >> 8 & 255), other.ids[y[match >> 16]] * 256 + (match & 255)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["id_f", "id_g"])


def rare_cells(met: DataFrame) -> DataFrame:
    """The rows of ``met``, with image_id, without each image's largest cells that hold VOTES - SHARED of its corners together.

    Cells are in one order, by size.  Let two images have VOTES matched corners each.  Of either,
    SHARED matched corners at least have a cell of a match that it keeps, as no more are in its dropped
    ones alone.  What the image that keeps fewer sizes keeps is kept by both; so SHARED corners of that
    image, at least, are matched in cells that both keep.
    """
    order = [F.col("m").desc(), F.col("block")]
    w = met.withColumn("image_id", _image("id")).repartition("image_id")
    w = w.withColumn("fresh", F.when(F.row_number().over(Window.partitionBy("image_id", "id").orderBy(*order)) == 1, 1).otherwise(0))
    w = w.withColumn("n", F.sum("fresh").over(Window.partitionBy("image_id").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)))
    return w.where(F.col("n") > VOTES - SHARED).drop("fresh", "n")


def framed(found: DataFrame, met: DataFrame, group: DataFrame) -> DataFrame:
    """Each image that has rare cells, with those, its corners and its component by ``group`` (id, component), in files by part."""
    corner = F.pmod("id", F.lit(256)).cast("short")
    w = rare_cells(met).groupBy("image_id").agg(F.collect_list("block").alias("blocks"), F.collect_list(corner).alias("at"))
    of = found.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(corner.alias("corner"), "words", "scale", "angle"))).alias("v"))
    of = of.select("image_id", F.col("v.corner").alias("corners"), F.expr("aggregate(v.words, cast('' as binary), (x, y) -> x || y)").alias("words"), F.col("v.scale").alias("scale"), F.col("v.angle").alias("angle"))
    w = w.join(of, "image_id").join(group.withColumnRenamed("id", "image_id"), "image_id", "left").withColumn("component", F.coalesce("component", "image_id"))
    # about as many parts as CHUNK asks for; which they are changes no result
    parts = max(1, -(-found.agg(F.approx_count_distinct("image_id")).first()[0] // CHUNK))
    w = w.withColumn("part", F.pmod(F.xxhash64("image_id"), F.lit(parts)).cast("int"))
    return materialize(w.coalesce(FILES), "framed", by="part")


def _searched(found: DataFrame, met: DataFrame, group: DataFrame, run: Callable[[_Side, _Side], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` finds in each part of the images and in each two of them.

    A task reads its one or two parts from their files, so parts are neither shuffled nor stored again for each other
    part: what is on disk grows with the images, although the parts that are read grow with their square.
    """
    images = framed(found, met, group)
    parts = sorted(r.part for r in images.select("part").distinct().collect())
    pairs = [(i, j) for k, i in enumerate(parts) for j in parts[k:]]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            g = pa.Table.from_batches(held)
            sides = [_Side(g.filter(pc.equal(g.column("part"), k))) for k in pc.unique(g.column("part"))]
            held.clear()
            yield from run(sides[0], sides[-1])

    spark = found.sparkSession
    out, before = [spark.createDataFrame([], schema)], spark.conf.get(UNION, None)
    spark.conf.set(UNION, "false")  # else a union of single partitions is a single one, and so one task
    try:
        for at in range(0, len(pairs), SEARCHES):
            some = [images.where(F.col("part").isin(i, j)).coalesce(1).mapInArrow(search, schema) for i, j in pairs[at : at + SEARCHES]]
            out.append(materialize(reduce(DataFrame.union, some), "candidates"))
    finally:
        if before is None:
            spark.conf.unset(UNION)
        else:
            spark.conf.set(UNION, before)
    discard(images)
    return reduce(DataFrame.union, out)


def unconnected_pairs(found: DataFrame, met: DataFrame, group: DataFrame, alike: bool = False) -> DataFrame:
    """(a, b): the images that ``group`` (id, component) does not connect, with SHARED corners of either matched in cells that are rare for both.

    ``alike``: only those of which so many matches agree in scale and turn, as those of a copy do; of VOTES that agree, the
    rare cells keep SHARED.  Images go in parts of about CHUNK, and each two parts are one task's work: it counts what a
    pair of images shares in all cells, so matches of single corners, which grow with the square of the images, leave no task.
    """

    def run(one: _Side, other: _Side) -> Iterator[pa.RecordBatch]:
        for x, y in _agreeing(one, other, alike):
            a, b = one.ids[x], other.ids[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return _searched(found, met, group, run, "a long, b long")


def unconnected_matches(found: DataFrame, met: DataFrame, group: DataFrame) -> DataFrame:
    """(id_f, id_g): the matches, in any cell, of those ``unconnected_pairs`` alike in scale and turn of which VOTES corners match so.

    The task that finds a pair has both images, and compares them at once: pairs that share a few corners by
    chance, which grow with the square of the images, leave no task, and images are not sent to one another.
    """

    def run(one: _Side, other: _Side) -> Iterator[pa.RecordBatch]:
        for x, y in _agreeing(one, other, True):
            yield from _compared(one, other, x, y)

    return _searched(found, met, group, run, "id_f long, id_g long")


def compared(found: DataFrame, images: DataFrame) -> DataFrame:
    """(id_f, id_g, _a, _b: their images): all matches, in any cell, of the pairs (a, b) of images in which VOTES corners of each match.

    For pairs that are given as rows; ``unconnected_matches`` compares those that it finds itself, and is tested against this.
    """
    packed = found.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("id", "words"))).alias("v"))
    packed = materialize(packed.select("image_id", F.col("v.id").alias("ids"), F.expr("aggregate(v.words, cast('' as binary), (x, y) -> x || y)").alias("words")), "packed")
    # an image is sent once for each that it is compared with, and once for each SALT_ROWS that are compared with it
    salts = images.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    own = images.join(salts, "b").select(F.col("a").alias("image_id"), F.col("b").alias("key"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("tail"))
    heads = salts.select(F.col("b").alias("image_id"), F.col("b").alias("key"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tail"))
    dealt = packed.join(own.union(heads), "image_id").select("key", "salt", "tail", "ids", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for batch in batches:
            out = []
            for key, salt, tail, x, p in zip(*(batch.column(c) for c in ("key", "salt", "tail", "ids", "words")), strict=True):
                u = np.frombuffer(p.as_buffer(), np.uint32).reshape(-1, WORDS)
                if tail.as_py() == 0:
                    now, head = (key, salt), (x.values.to_numpy(), u)
                elif (key, salt) == now:
                    other = u[:, None] ^ head[1]
                    same = other == 0
                    near = (same & np.roll(same, -1, 2)).any(2) & (np.bitwise_count(other).sum(2) <= BITS)
                    if near.any(1).sum() >= VOTES and near.any(0).sum() >= VOTES:
                        r, s = near.nonzero()
                        out.append((x.values.to_numpy()[r], head[0][s]))
            f, g = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(g), pa.array(f >> 8), pa.array(g >> 8)], ["id_f", "id_g", "_a", "_b"])

    return dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "tail").mapInArrow(run, "id_f long, id_g long, _a long, _b long")


def consensus(matched: DataFrame) -> DataFrame:
    """(a, b, votes) of the pairs with VOTES corners for one transform: scale and turn in steps, shift in cells of two layouts."""
    m = matched.withColumn("s", F.col("scale_g") / F.col("scale_f"))
    m = m.withColumn("turn", F.pmod(F.rint((F.col("angle_g") - F.col("angle_f")) * (12 / (2 * np.pi))), F.lit(12)))
    c, s = F.cos(F.col("turn") * (2 * np.pi / 12)) * F.col("s"), F.sin(F.col("turn") * (2 * np.pi / 12)) * F.col("s")
    m = m.withColumn("dx", F.col("x_g") - (c * F.col("x_f") - s * F.col("y_f"))).withColumn("dy", F.col("y_g") - (s * F.col("x_f") + c * F.col("y_f")))
    m = m.withColumn("shift", F.explode(F.array(F.lit(0.0), F.lit(0.5))))
    bins = [F.rint(F.log2("s") * 4).cast("int").alias("size"), "turn", F.floor(F.col("dx") / CELL + F.col("shift")).alias("bx"), F.floor(F.col("dy") / CELL + F.col("shift")).alias("by"), "shift"]
    v = m.groupBy("a", "b", *bins).agg(F.least(F.countDistinct("id_f"), F.countDistinct("id_g")).alias("votes"))
    return v.groupBy("a", "b").agg(F.max("votes").alias("votes")).where(F.col("votes") >= VOTES)


def copies(images: DataFrame) -> DataFrame:
    """image_id, n_corners and group_id (the least image_id reachable over copies) of every image.

    Null, empty or undecodable images, and those without corners, are alone in their
    groups; images of a null id are left without descriptors and have a null group; rows
    that repeat an id are one image in the result's links and each a row; an empty table
    gives an empty result; other columns are not read.
    """
    all_ = materialize(described(images), "corners")
    found = all_.where("id is not null")
    met = cells(found)
    pairs = pivot_pairs(met)
    links = materialize(consensus(matches(found, pairs)).select("a", "b"), "links")
    discard(pairs)
    rest = unconnected_matches(found, met, connected_components(links))
    discard(met)
    links = links.union(consensus(matches(found, rest)).select("a", "b"))
    group = connected_components(links).withColumnRenamed("id", "image_id")
    n = found.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_corners"))
    out = all_.where("id is null").select("image_id").join(n, "image_id", "left").join(group, "image_id", "left")
    return out.select("image_id", F.coalesce("n_corners", F.lit(0)).alias("n_corners"), F.coalesce("component", "image_id").alias("group_id"))


def drawn(seed: int, side: int = 96) -> np.ndarray:
    """A grey test image of overlapping rectangles and discs."""
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:side, :side]
    a = np.full((side, side), rng.uniform(60, 200))
    for _ in range(24):
        y, x, h, w, grey = rng.uniform(0, side), rng.uniform(0, side), rng.uniform(6, side / 3), rng.uniform(6, side / 3), rng.uniform(0, 255)
        inside = (abs(yy - y) < h / 2) & (abs(xx - x) < w / 2) if rng.uniform() < 0.7 else (yy - y) ** 2 + (xx - x) ** 2 < (h / 2) ** 2
        a[inside] = 0.3 * a[inside] + 0.7 * grey
    return a


def pgm(a: np.ndarray) -> bytes:
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def edited(a: np.ndarray, kind: int) -> np.ndarray:
    """A crop (0), a change of light with noise (1), or a quarter turn of a crop (2)."""
    h, w = a.shape
    if kind == 0:
        return a[h // 8 :, : w - w // 10]
    if kind == 1:
        return a * 0.8 + 30 + np.random.default_rng(3).normal(0, 1, a.shape)
    return np.rot90(a[h // 12 :, w // 12 :])


def drawn_from(vectors: DataFrame) -> DataFrame:
    """Images (image_id, image) drawn from vectors: 4 * vec_id from the vector's bytes; after each fifth an edited copy.

    There is no image table; these rows stand in for one.  Every vector has its image;
    those whose vec_id leaves 0, 1 or 2 modulo 15 also have an edited copy, 4 * vec_id + 1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for vec_id, v in zip(b.vec_id, b.embedding, strict=True):
                a = drawn(zlib.crc32(np.asarray(v, np.float64).tobytes()) if v is not None else 0)
                out.append((4 * vec_id, pgm(a)))
                if vec_id % 15 < 3:
                    out.append((4 * vec_id + 1, pgm(edited(a, vec_id % 15))))
            yield pd.DataFrame(out, columns=["image_id", "image"])

    return vectors.select("vec_id", "embedding").where("vec_id is not null").mapInPandas(run, "image_id long, image binary")
