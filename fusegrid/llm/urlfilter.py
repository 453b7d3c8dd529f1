"""URL verdicts from path rules and a Bloom filter cascade of listed hosts.

The cascade is exact over the corpus's complete key universe: level 0 holds the listed
keys; each next level holds those keys of the other side that the level before takes
for its own, until none is left.  Keys are dealt to segments of a bounded number of
keys by hash, and each segment's cascade is built by one task.  The filters are
broadcast if their measured size is within ``BROADCAST_BYTES``; beyond it rows are dealt to
their segments' filters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusegrid.plans.scratch import materialize

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host is listed if one of its labels is one of these.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SEGMENT_KEYS, BITS, HASHES, MOST_LEVELS = 1 << 16, 8, 4, 64
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _bits(h1: np.ndarray, h2: np.ndarray, level: int, m: np.ndarray | int) -> np.ndarray:
    """(HASHES, n) bit numbers below m."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    a, b = h1.astype(np.uint64) ^ salt, h2.astype(np.uint64) | np.uint64(1)
    x = a[None] + np.arange(HASHES, dtype=np.uint64)[:, None] * b[None]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(20)) % np.asarray(m, np.uint64)


def build_levels(listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Bit arrays (one byte of 0 or 1 a bit) of a segment's levels."""
    levels = []
    while len(listed[0]):
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("two keys have the same hashes; no cascade can tell them apart")
        m = max(64, BITS * len(listed[0]))
        bits = np.zeros(m, np.uint8)
        bits[_bits(*listed, len(levels), m)] = 1
        taken = bits[_bits(*others, len(levels), m)].all(0)
        listed, others = tuple(x[taken] for x in others), listed
        levels.append(bits)
    return levels


def build(keys: DataFrame) -> DataFrame:
    """(segment, segments, level, m, bits) from the distinct (key, listed) rows of the universe."""
    held = materialize(keys.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), "listed"), "keys")
    segments = max(1, -(-held.count() // SEGMENT_KEYS))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        h1, h2, y = part.h1.to_numpy(), part.h2.to_numpy(), part.listed.to_numpy(bool)
        levels = build_levels((h1[y], h2[y]), (h1[~y], h2[~y]))
        return pd.DataFrame({"segment": part.segment.iloc[0], "level": range(len(levels)), "m": [len(b) for b in levels], "bits": [np.packbits(b).tobytes() for b in levels]})

    grouped = held.withColumn("segment", _segment(segments)).groupBy("segment")
    return grouped.applyInPandas(one, "segment long, level int, m long, bits binary").withColumn("segments", F.lit(segments))


def _segment(segments: int | Column) -> Column:
    return F.pmod(F.shiftright(F.col("h1"), 17), F.lit(segments) if isinstance(segments, int) else segments).cast("long")


class Cascade:
    """Lookups in the levels of some segments."""

    def __init__(self, rows: pd.DataFrame, segments: int):
        self.depth = int(rows.level.max()) + 1 if len(rows) else 0
        self.m = np.zeros((self.depth, segments), np.int64)
        self.at = np.zeros((self.depth, segments), np.int64)
        bytes_, end = [], 0
        for s, level, m, bits in zip(rows.segment, rows.level, rows.m, rows.bits, strict=True):
            self.m[level, s], self.at[level, s] = m, end
            bytes_.append(np.frombuffer(bits, np.uint8))
            end += len(bits)
        self.bytes = np.concatenate(bytes_) if bytes_ else np.zeros(0, np.uint8)

    def listed(self, h1: np.ndarray, h2: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """A key belongs to the side opposite to the first level that lacks it, or to the side of the last level."""
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for level in range(self.depth):
            m = self.m[level, segment[open_]]
            out[open_[m == 0]] = level % 2 == 1  # no such level: the one before was this key's last
            open_, m = open_[m > 0], m[m > 0]
            bit = _bits(h1[open_], h2[open_], level, m)
            has = (self.bytes[self.at[level, segment[open_]] + (bit >> np.uint64(3)).astype(np.int64)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1).all(0)
            out[open_[~has]] = level % 2 == 1
            open_ = open_[has]
        out[open_] = self.depth % 2 == 1
        return out


def member(rows: DataFrame, cascade: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` (with a string column ``key``) plus ``listed``."""
    cascade = materialize(cascade, "cascade")
    size = cascade.agg(F.coalesce(F.sum(F.length("bits") + 32), F.lit(0)), F.coalesce(F.max("segments"), F.lit(1))).first()
    hashed = rows.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64("key", F.lit(1))}).withColumn("segment", _segment(int(size[1])))
    schema = f"{rows.schema.simpleString()[7:-1]},listed:boolean"
    columns = [*rows.columns, "listed"]
    if size[0] <= broadcast_bytes:
        held, segments = cascade.toPandas(), int(size[1])

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = Cascade(held, segments)
            for b in batches:
                yield b.assign(listed=c.listed(b.h1.to_numpy(), b.h2.to_numpy(), b.segment.to_numpy()))[columns]

        return hashed.mapInPandas(near, schema)

    def far(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = Cascade(right.assign(segment=0), 1)
        return left.assign(listed=c.listed(left.h1.to_numpy(), left.h2.to_numpy(), np.zeros(len(left), np.int64)))[columns]

    salts = 64  # a hot host's rows go to this many tasks
    left = hashed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = cascade.drop("segments").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.groupBy("segment", "salt").cogroup(right.groupBy("segment", "salt")).applyInPandas(far, schema)


def listed_host(host: Column, labels: Sequence[str] = LISTED_LABELS) -> Column:
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: Sequence[str] = LISTED_LABELS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A null url, or one without ``://``, has an empty host and path: no rule fits it, and the
    empty host is not listed, so it is allowed.  Repeated rows are judged one by one;
    an empty table gives an empty result; other columns are not read.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("key"), path_of(F.col("url")).alias("path"))
    keys = p.select("key").distinct().withColumn("listed", listed_host(F.col("key"), labels))
    out = member(p, build(keys), broadcast_bytes)
    hit = rule_of(F.col("key"), F.col("path"), rules)
    out = out.withColumn("hit", hit)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", F.col("key").alias("host"), "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"))
