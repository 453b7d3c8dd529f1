"""Exact candidates for Jaccard joins of large collections of sets, in linear space.

Let t be the least similarity.  Two sets of n1 <= n2 elements with Jaccard >= t differ in
at most ``(1-t)/(1+t) * (n1+n2)`` elements.  Elements are hashed into k groups, more
than that bound for the size class of the larger set; so some group has equal content
in both sets, and the hash of a group's content is a key that both share.  k also
exceeds the bound by the number of groups that an ordinary set leaves empty, so that
an agreeing group with elements exists; a set with more empty groups than that also
posts the empty ones (``keys``).  So frequent elements make no frequent keys: near
copies share a block, and few other sets do.

Keys travel packed, ten bytes each, as one binary for each bucket and stretch of
input, and a bucket's task keeps the keys that two different sets post.  Sets are
named by a 64-bit fingerprint; equal sets fall together before anything is posted.
Which pairs of a block go on, and how, is left to the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, exp, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.words import mix
from fusegrid.plans.scratch import materialize

ENTRY = np.dtype([("key", "<u4"), ("low", "<u4"), ("high", "<i2")])
#: Sets travel under the last bits of their names; sets that share them are candidates of one another's blocks.
ID_BITS = 48
FLUSH = 1 << 20
#: Members of a block in one row.
PIECE = 1 << 14
#: Text that is worked on at once, in bytes.
CHUNK_BYTES = 1 << 19
#: Sets that are verified against one other in one task's run; a set with more is repeated.
SALT_ROWS = 512
#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Threshold:
    """Jaccard >= num / den."""

    num: int
    den: int

    @cached_property
    def lows(self) -> np.ndarray:
        """Least size of each size class; sizes in a class differ by the factor (den/num)**2 at most."""
        out, x = [1], 1.0
        while out[-1] < 1 << 40:
            x *= (self.den / self.num) ** 2
            if ceil(x) > out[-1]:
                out.append(ceil(x))
        return np.array(out, np.int64)

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(k, spare) of each size class."""
        ks, spares = [], []
        for low, high in zip(self.lows[:-1].tolist(), (self.lows[1:] - 1).tolist(), strict=True):
            k = (self.den - self.num) * 2 * high // (self.den + self.num) + 1
            spare = 0 if k == 1 else 1 + floor(2 * k * exp(-low / k))
            ks.append(k + spare)
            spares.append(spare)
        return np.array(ks, np.int64), np.array(spares, np.int64)

    def classes(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, "right") - 1

    def linked(self, both: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        """Whether sets of n1 and n2 elements with ``both`` common ones reach the threshold."""
        return (both > 0) & (self.den * both >= self.num * (n1 + n2 - both))

    def sizes_fit(self, n1, n2):
        """Length filter, for numbers, arrays or columns."""
        return (self.num * n1 <= self.den * n2) & (self.num * n2 <= self.den * n1)


def fingerprints(elements: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit names of sets given as consecutive distinct elements; 0 elements: 0."""
    total = np.zeros(len(n) + 1, np.uint64)
    run = np.concatenate(([np.uint64(0)], np.cumsum(mix(elements ^ np.uint64(0x5851F42D4C957F2D)))))
    ends = np.concatenate(([0], np.cumsum(n)))
    total = run[ends[1:]] - run[ends[:-1]]
    return np.where(n > 0, mix(total + n.astype(np.uint64)), np.uint64(0)).view(np.int64)


def keys(t: Threshold, ids: np.ndarray, n: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit key, set id) of every posting of sets given as consecutive elements."""
    ks, spares = t.groups
    row = np.repeat(np.arange(len(n)), n)
    first, last = t.classes(np.maximum(n, 1)), t.classes(np.maximum(n * t.den // t.num, 1))
    value = (mix(elements) & np.uint64(0xFFFFFFFF)).astype(np.float64)
    out_key, out_id, step = [], [], 0
    while len(n):
        active = (n > 0) & (first + step <= last)
        if not active.any():
            break
        c = first + step
        k = np.where(active, ks[np.minimum(c, len(ks) - 1)], 0)
        base = np.cumsum(k) - k
        total = int(k.sum())
        on = active[row]
        group = (((elements[on] >> np.uint64(32)) * k[row[on]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        slot = base[row[on]] + group
        content = np.bincount(slot, value[on], total)
        full = np.bincount(slot, minlength=total) > 0
        owner = np.repeat(np.arange(len(n)), k)
        g = np.arange(total) - base[owner]
        empty = np.bincount(owner[~full], minlength=len(n))
        post = full | (empty > spares[np.minimum(c, len(ks) - 1)])[owner]
        owner, g = owner[post], g[post]
        where = mix((c[owner] * (1 << 40) + g).astype(np.uint64))
        out_key.append(mix(content[post].astype(np.uint64) + where))
        out_id.append(ids[owner])
        step += 1
    return (np.concatenate(out_key), np.concatenate(out_id)) if out_key else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def chunks(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about CHUNK_BYTES of a string column."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(size) // CHUNK_BYTES
        at = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


KeysOf = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def blocks(source: DataFrame, keys_of: KeysOf) -> DataFrame:
    """(block, short, m): the m sets that share a key, for keys of two different sets or more.

    ``source`` has an id and a text column; ``keys_of`` gives the keys of a slice's sets, and the sets' ids.
    """
    spark = source.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_id, held = [], [], 0

        def flush():
            key, ids = np.concatenate(held_key), np.concatenate(held_id)
            bucket = (((key >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
            entries = np.empty(len(key), ENTRY)
            ids = ids[order].view(np.uint64)
            entries["key"], entries["low"], entries["high"] = (key[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32), (ids >> np.uint64(32)).astype(np.uint16).view(np.int16)
            ends = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n_buckets))))
            used = np.flatnonzero(np.diff(ends))
            blobs = [entries[ends[b] : ends[b + 1]].tobytes() for b in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "entries"])

        for part in chunks(batches):
            key, ids = keys_of(part)
            held_key.append(key)
            held_id.append(ids)
            held += len(key)
            if held >= FLUSH:
                yield from flush()
                held_key, held_id, held = [], [], 0
        if held:
            yield from flush()

    def meet(part: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(x, ENTRY) for x in part.column("entries").to_pylist()])
        order = np.sort(entries["key"].astype(np.uint64) << np.uint64(32) | np.arange(len(entries), dtype=np.uint64))
        key = order >> np.uint64(32)
        same = key[1:] == key[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        chosen = entries[(order[many] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        key, ids = key[many], chosen["high"].astype(np.int64) << 32 | chosen["low"].astype(np.int64)
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[fresh], ids[fresh]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        m = np.diff(np.append(starts, len(key)))
        keep = np.repeat(m > 1, m)
        ids, m = ids[keep], m[m > 1]
        starts = np.cumsum(m) - m
        name = np.add.reduceat(mix(ids.view(np.uint64)), starts) if len(m) else np.zeros(0, np.uint64)
        # long blocks go in pieces, so that no row is long
        pieces = -(-m // PIECE)
        block = np.repeat(np.arange(len(m)), pieces)
        piece = np.arange(len(block)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = starts[block] + piece * PIECE
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids))
        columns = [pa.array(mix(name[block]).view(np.int64)), pa.array(piece), pa.array(m[block]), pa.array(ids[starts[block]] if len(block) else ids), lists]
        return pa.Table.from_arrays(columns, ["block", "piece", "m", "low", "members"])

    posted = source.mapInArrow(post, "bucket long, entries binary")
    met = posted.groupBy("bucket").applyInArrow(meet, "block long, piece long, m long, low long, members array<long>")
    # of blocks with the same members, by their names, one is enough
    met = materialize(met.dropDuplicates(["block", "piece", "m", "low"]), "met")
    out = met.select("block", F.explode("members").alias("short"), "m")
    out.scratch_path = met.scratch_path  # for who empties it when it is read
    return out


def short(name: Column) -> Column:
    """The number under which a set travels: the last ID_BITS of its name, signed."""
    return F.shiftright(F.shiftleft(name, 64 - ID_BITS), 64 - ID_BITS)


def semi(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is in the materialised one-column table ``ids``."""
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(side, column, "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, t: Threshold, unpack: Callable[[bytes], np.ndarray]) -> DataFrame:
    """The pairs (y, x), a materialised table, whose sets (id, elements) reach the threshold.

    Each set y goes to the x that it is verified against, and x itself once for each
    SALT_ROWS of them, so no task holds more than two sets.  ``unpack`` gives the sorted
    numbers of a set; sets that no pair names may be among ``sets``.
    """
    salts = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    own = pairs.join(salts, "x").select(F.col("y").alias("id"), F.col("x").alias("key"), F.pmod(F.xxhash64("y"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("tail"))
    heads = salts.select(F.col("x").alias("id"), F.col("x").alias("key"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tail"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for b in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for key, salt, tail, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tail == 0:
                    now, head = (key, salt), unpack(x)
                elif (key, salt) == now and reached(t, head, unpack(x)):
                    found[0].append(y)
                    found[1].append(key)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["y", "x"])

    dealt = sets.join(own.union(heads), "id").select("key", "salt", "tail", "id", "elements")
    return dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "tail").mapInArrow(check, "y long, x long")


def reached(t: Threshold, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if not len(a) or not len(b) or not t.sizes_fit(len(a), len(b)):
        return False
    both = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return bool(t.den * both >= t.num * (len(a) + len(b) - both))


def sketches(elements: np.ndarray, n: np.ndarray, least: int = 64) -> list[bytes]:
    """Parities of each set's elements over about twice as many cells, a power of two of ``least`` or more."""
    size = np.maximum(least, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(n)), n)
    at = base[row] + (mix(elements ^ np.uint64(0x9FB21C651E98DF25)) & (size[row] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=int(size.sum())) & 1).astype(np.uint8), bitorder="little")
    return [bits[a : a + k].tobytes() for a, k in zip((base >> 3).tolist(), (size >> 3).tolist(), strict=True)]


def differing(a: bytes, b: bytes) -> int:
    """Parities in which two sketches differ, at most the number of elements that only one set has.

    Cells are taken by low bits of a hash, so a sketch of half the cells is the exclusive or of its halves.
    """
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
