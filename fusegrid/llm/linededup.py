"""Line deduplication by an exact set-similarity join over rarity-ordered prefixes.

A line is the set of its words.  A line goes if an earlier one (by document id, then
place) has a Jaccard similarity of the threshold or more, kept or not; all others stay.

1. One pass names every line by a fingerprint of its set and counts words.  Equal lines
   fall together by a map-side combined minimum: all but the first go without any postings.
2. Words are numbered by their rarity over the whole corpus, so every set has one global
   order.  Two sets of n1 and n2 words that match share a word among the first
   ``n - ceil(t*n) + 1`` of each, their prefixes (prefix filter).  So each line is posted
   under the words of its prefix, with its size, the word's position and 128 parities of
   its words; a task posts equal lines once.
3. Where postings of a word meet, pairs pass the length filter (a window in order of size),
   the parity bound and the positional filter (the words before and after the common one
   bound the overlap).  A line needs one earlier match only, so each gets, of its surviving
   earlier lines, the one whose parities are most alike.  In large groups the earliest lines are
   tried first, so groups of near copies take linear work.  Words with too many open
   comparisons are split into parts whose pairs are dealt out to tasks.
4. Candidates are verified on their whole sets, streamed through salted groups.  Lines whose
   candidate failed are searched once more, against all their candidates.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.bitmaps import PIECES, filter_of, held, pieces, summed
from fusegrid.llm.setjoin import Threshold, chunks, fingerprints, verified
from fusegrid.llm.words import buffers, distinct, mix, words_of
from fusegrid.plans.scratch import discard, materialize

THRESHOLD, MIN_TOKENS = Threshold(4, 5), 5
#: A token is a number of TOKEN_BITS; its low CELL_BITS name its cell of the corpus-wide counts.
TOKEN_BITS, CELL_BITS = 48, 18
CELLS, REST_BITS = 1 << CELL_BITS, TOKEN_BITS - CELL_BITS
#: Bytes of a token's number when sets travel.
BYTES = TOKEN_BITS // 8
#: Postings in one flush of a task; comparisons of one word that its bucket's task makes itself; postings in a part.
FLUSH, HEAVY, PART = 1 << 20, 1 << 30, 1 << 15
#: Pairs that are worked on at once; postings of a large group, and the earliest of them that are tried first there.
STEP, LARGE, FIRST = 1 << 21, 64, 4
#: The columns of a posting, but for its sketches: 128 parities each, as two numbers.
POSTING = {"key": np.uint32, "n": np.int32, "at": np.int32, "place": np.int32, "doc": np.int64, "id": np.int64}
#: Sketches of a posting in the first search, and in the second, where few lines would else have many candidates each.
SKETCHES, MORE_SKETCHES = 1, 3
FOUND = "y long, y_doc long, y_place long, x long, x_doc long, x_place long, unlike float, more boolean, word long, part int, parts int, postings binary"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def line_tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each line, its place, line of each word, the word's token) of a slice's texts (column 1), in order."""
    data, offsets = buffers(batch.column(1))
    ends = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1], ends + 1)))
    starts = starts[starts < offsets[-1]] if len(data) else np.zeros(0, np.int64)
    h, at, _ = words_of(data, offsets)
    words = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    row = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets[row])
    return row, np.arange(len(starts)) - first, np.repeat(np.arange(len(starts)), words), h >> np.uint64(64 - TOKEN_BITS)


def sets_of(line: np.ndarray, token: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each line's set in order of their numbers, set sizes)."""
    if lines >> (64 - TOKEN_BITS):
        s, _, n = distinct(token, line, lines)
        return s, n
    both = np.sort(line.astype(np.uint64) << np.uint64(TOKEN_BITS) | token)
    fresh = np.ones(len(both), bool)
    fresh[1:] = both[1:] != both[:-1]
    both = both[fresh]
    return both & np.uint64((1 << TOKEN_BITS) - 1), np.bincount((both >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=lines)


def compared(batch: pa.RecordBatch, least: int, ranks: tuple[np.ndarray, np.ndarray] | None = None):
    """(row, place, name, size, tokens) of the compared lines; with (rank of each cell, cell of each rank), tokens are numbered by rarity and names are left to ``named``."""
    row, place, line, token = line_tokens(batch)
    if ranks is not None:
        rank, cell = ranks
        token = rank[(token & np.uint64(CELLS - 1)).astype(np.int64)] << np.uint64(REST_BITS) | token >> np.uint64(CELL_BITS)
    tokens, n = sets_of(line, token, len(row))
    ok = n >= least
    tokens, n = tokens[np.repeat(ok, n)], n[ok]
    return row[ok], place[ok], fingerprints(tokens, n) if ranks is None else None, n, tokens


def named(tokens: np.ndarray, n: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The names of sets whose tokens are numbered by rarity."""
    return fingerprints((tokens & np.uint64((1 << REST_BITS) - 1)) << np.uint64(CELL_BITS) | cell[(tokens >> np.uint64(REST_BITS)).astype(np.int64)], n)


def prefix_sizes(t: Threshold, n: np.ndarray) -> np.ndarray:
    return n - -(-t.num * n // t.den) + 1


def parities(tokens: np.ndarray, n: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """128 parities of each (non-empty) set's tokens, as two numbers: sets that differ in d tokens differ in d parities at most."""
    if not len(n):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    cell = mix(tokens ^ np.uint64(salt * 0x632BE59BD9B4E019)) >> np.uint64(57)
    bit = np.uint64(1) << (cell & np.uint64(63))
    low = cell < 64
    return tuple(np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), np.cumsum(n) - n) for half in (low, ~low))


def layout(sketches: int) -> dict[str, type]:
    return POSTING | {f"{c}{k}": np.uint64 for k in range(sketches) for c in "pq"}


Columns = dict[str, np.ndarray]


class Postings:
    """The postings of some lines, under the words of their prefixes; equal lines are posted once, by the earliest."""

    def __init__(self, t: Threshold, n_buckets: int, cell: np.ndarray, words: np.ndarray | None = None):
        self.t, self.n_buckets, self.cell, self.words, self.size = t, n_buckets, cell, words, 0
        self.sketches = SKETCHES if words is None else MORE_SKETCHES
        self.lines: list[Columns] = []
        self.posted: list[Columns] = []

    def add(self, n, tokens, doc, place) -> None:
        """Lines whose sets are given as consecutive tokens in order of rarity; of a filter ``words`` only those words."""
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(tokens)) - (np.cumsum(n) - n)[row]
        post = np.flatnonzero(at < prefix_sizes(self.t, n)[row])
        word = mix(tokens[post])
        bucket = (((word >> np.uint64(32)) * np.uint64(self.n_buckets)) >> np.uint64(32)).astype(np.int64)
        key = (word & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if self.words is not None:
            ok = held(self.words, bucket << 32 | key)
            post, bucket, key = post[ok], bucket[ok], key[ok]
            # only lines that post anything need sketches
            used = np.zeros(len(n), bool)
            used[row[post]] = True
            number = np.cumsum(used) - 1
            at, row, tokens = at[post], number[row[post]], tokens[np.repeat(used, n)]
            n, doc, place = n[used], doc[used], place[used]
        else:
            at, row = at[post], row[post]
        first = sum(len(x["id"]) for x in self.lines)
        sketches = {f"{c}{k}": x for k in range(self.sketches) for c, x in zip("pq", parities(tokens, n, k), strict=True)}
        # what waits for the flush has the widths of its posting
        self.lines.append({"n": n.astype(np.int32), "place": place.astype(np.int32), "doc": doc, "id": named(tokens, n, self.cell)} | sketches)
        self.posted.append({"bucket": bucket.astype(np.int32), "key": key.astype(np.uint32), "at": at.astype(np.int32), "line": (first + row).astype(np.int32)})
        self.size += len(post)

    def flush(self) -> pa.RecordBatch:
        """(bucket, postings), one row a bucket, in order of the lines, as neighbours in a document share most bytes."""
        lines = {k: np.concatenate([x[k] for x in self.lines]) for k in self.lines[0]}
        posted = {k: np.concatenate([x[k] for x in self.posted]) for k in self.posted[0]}
        order = np.lexsort((lines["place"], lines["doc"], lines["id"]))
        again = np.zeros(len(order), bool)
        again[order[1:]] = lines["id"][order][1:] == lines["id"][order][:-1]
        posted = _taken(posted, ~again[posted["line"]])
        bucket = posted["bucket"]
        posted = _taken(posted, np.argsort(bucket.astype(np.uint16) if self.n_buckets < 1 << 16 else bucket, kind="stable"))
        c = {"key": posted["key"], "at": posted["at"]} | _taken(lines, posted["line"])
        c = {k: c[k].astype(d, copy=False) for k, d in layout(self.sketches).items()}
        ends = np.concatenate(([0], np.cumsum(np.bincount(posted["bucket"], minlength=self.n_buckets))))
        used = np.flatnonzero(np.diff(ends))
        blobs = [_packed(_taken(c, slice(ends[k], ends[k + 1]))) for k in used]
        self.lines, self.posted, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "postings"])


def _taken(c: Columns, rows) -> Columns:
    return {k: v[rows] for k, v in c.items()}


def survive(t: Threshold, x: Columns, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs that pass, how unlike they are): the parity, positional and length filters on rows a and b of x, all of one word.

    The sets may differ in (1-t)/(1+t) of n1+n2 words, and in no fewer than their parities do.  With the common word at
    i and j, the overlap is at most min(i, j) + 1 + min(n1-i-1, n2-j-1); it must be t/(1+t) of n1+n2.
    """
    whole, least, most = t.num + t.den, t.num, t.den - t.num
    total, ok, unlike = x["n"][a] + x["n"][b], np.arange(len(a)), np.zeros(len(a), np.int32)
    for k in range((len(x) - len(POSTING)) // 2):
        far = np.bitwise_count(x[f"p{k}"][a] ^ x[f"p{k}"][b]).astype(np.int32)
        near = np.flatnonzero(far * whole <= most * total)
        a, b, total, ok, far, unlike = a[near], b[near], total[near], ok[near], far[near], unlike[near]
        far += np.bitwise_count(x[f"q{k}"][a] ^ x[f"q{k}"][b])
        near = np.flatnonzero(far * whole <= most * total)
        a, b, total, ok, unlike = a[near], b[near], total[near], ok[near], np.maximum(unlike[near], far[near])
    n1, n2, i, j = x["n"][a], x["n"][b], x["at"][a], x["at"][b]
    fine = t.sizes_fit(n1, n2) & (x["id"][a] != x["id"][b])
    fine &= (np.minimum(i, j) + 1 + np.minimum(n1 - i - 1, n2 - j - 1)) * whole >= least * total
    return ok[fine], unlike[fine] / total[fine]


def _packed(c: Columns) -> bytes:
    """Postings as planes of bytes, compressed: the many that are 0 or repeat take no space."""
    planes = [np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.itemsize).T) for v in c.values()]
    header = len(c["key"]).to_bytes(8, "little") + bytes([(len(c) - len(POSTING)) // 2])
    return header + pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blobs: list[bytes]) -> Columns:
    kinds = layout(blobs[0][8])
    width, parts = sum(np.dtype(d).itemsize for d in kinds.values()), []
    for x in blobs:
        n = int.from_bytes(x[:8], "little")
        parts.append(np.frombuffer(pa.decompress(x[9:], n * width, codec="zstd"), np.uint8).reshape(width, n))
    planes, out, at = np.concatenate(parts, 1), {}, 0
    for k, d in kinds.items():
        size = np.dtype(d).itemsize
        out[k] = np.ascontiguousarray(planes[at : at + size].T).reshape(-1).view(d)
        at += size
    return out


def _ages(c: Columns) -> np.ndarray:
    """Numbers in order of (doc, place), equal for equal ones."""
    order = np.lexsort((c["place"], c["doc"]))
    doc, place = c["doc"][order], c["place"][order]
    age = np.empty(len(order), np.int64)
    age[order] = np.cumsum(np.concatenate(([False], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])))[: len(order)])
    return age


class _Group:
    """Postings of words that two lines or more share, each line once a word, in order of word and size."""

    def __init__(self, c: Columns):
        # sorted by word; what stands alone goes first
        order = np.sort(c["key"].astype(np.uint64) << np.uint64(32) | np.arange(len(c["key"]), dtype=np.uint64))
        key = order >> np.uint64(32)
        same = key[1:] == key[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(key) else np.zeros(0, bool)
        c = _taken(c, (order[many] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        age = _ages(c)
        # postings of one word and line by different tasks: the earliest stays
        order = np.argsort(age, kind="stable")
        order = order[np.argsort((c["key"].astype(np.uint64) << np.uint64(32) | c["id"].view(np.uint64) & np.uint64(0xFFFFFFFF))[order], kind="stable")]
        key, ids = c["key"][order], c["id"][order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        order = order[fresh]
        order = order[np.argsort(c["key"][order].astype(np.int64) << 32 | c["n"][order], kind="stable")]
        self.c, self.age = _taken(c, order), age[order]
        key = self.c["key"]
        self.starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        self.sizes = np.diff(np.append(self.starts, len(key)))
        self.group = np.repeat(np.arange(len(self.starts)), self.sizes)

    def earliest(self, k: int, among: np.ndarray) -> np.ndarray:
        """(k, groups): the k earliest lines of each group of which all rows are in ``among``, by age; -1 where there are fewer."""
        order = among[np.lexsort((self.age[among], self.group[among]))]
        group = self.group[order]
        fresh = np.concatenate((np.ones(min(1, len(order)), bool), group[1:] != group[:-1]))
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        out = np.full((k, len(self.starts)), -1)
        chosen = place < k
        out[place[chosen], self.group[order][chosen]] = order[chosen]
        return out

    def windows(self, t: Threshold, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) of the postings of the same word whose size fits that of postings y."""
        place = self.group << 32 | self.c["n"]
        g, n = self.group[y] << 32, self.c["n"][y].astype(np.int64)
        return np.searchsorted(place, g | -(-n * t.num // t.den)), np.searchsorted(place, g | np.minimum(n * t.den // t.num, (1 << 32) - 1), "right")


def _ranges(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(y repeated, low to high) in steps of about STEP pairs; a range longer than that goes in parts."""
    count = np.maximum(high - low, 0)
    ends, i = np.cumsum(count), 0
    while i < len(y):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + STEP, "right")))
        if j == i + 1:
            for a in range(int(low[i]), int(high[i]), STEP):
                other = np.arange(a, min(a + STEP, int(high[i])))
                yield np.full(len(other), y[i]), other
        else:
            one = np.repeat(np.arange(i, j), count[i:j])
            yield y[one], low[one] + np.arange(len(one)) - (ends[one] - count[one] - before)
        i = j


class _Best:
    """For each line, of the earlier lines found so far the one most like it, and how many there were."""

    def __init__(self, size: int):
        self.x, self.unlike, self.count = np.full(size, -1), np.full(size, np.inf), np.zeros(size, np.int64)

    def add(self, y: np.ndarray, x: np.ndarray, unlike: np.ndarray) -> None:
        if not len(y):
            return
        self.count += np.bincount(y, minlength=len(self.count))
        order = np.lexsort((x, unlike, y))
        y, x, unlike = y[order], x[order], unlike[order]
        first = np.concatenate(([True], y[1:] != y[:-1]))
        y, x, unlike = y[first], x[first], unlike[first]
        better = unlike < self.unlike[y]
        self.x[y[better]], self.unlike[y[better]] = x[better], unlike[better]


def _found(y: Columns, x: Columns, unlike: np.ndarray, more: np.ndarray, word: np.ndarray) -> pa.Table:
    none = [pa.nulls(len(more), k) for k in (pa.int32(), pa.int32(), pa.binary())]
    columns = [y["id"], y["doc"], y["place"].astype(np.int64), x["id"], x["doc"], x["place"].astype(np.int64), unlike.astype(np.float32), more, word]
    return pa.Table.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), *none], FOUND_NAMES)


def _crowded(c: Columns, wanted: np.ndarray, word: int, part: int) -> pa.Table:
    """A word's postings in parts; their key only tells which lines still want a candidate."""
    c = c | {"key": wanted.astype(np.uint32)}
    parts = -(-len(wanted) // part)
    blobs = [_packed(_taken(c, slice(k * part, (k + 1) * part))) for k in range(parts)]
    none = [pa.nulls(parts, k) for k in (*[pa.int64()] * 6, pa.float32(), pa.bool_())]
    return pa.Table.from_arrays([*none, pa.array(np.full(parts, word)), pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, parts, np.int32)), pa.array(blobs, pa.binary())], FOUND_NAMES)


def _meet(t: Threshold, bucket: int, c: Columns, asked: np.ndarray | None, heavy: int, part: int, large: int) -> pa.Table:
    """What a bucket's postings find.  ``asked``: a filter of the only lines that need candidates, and then all of theirs."""
    g = _Group(c)
    e, out = g.c, []
    word = np.int64(bucket) << 32 | e["key"].astype(np.int64)
    best = _Best(len(word))
    if asked is None:
        big = np.flatnonzero(g.sizes[g.group] > large)
        for pivots in g.earliest(FIRST, big):
            x = pivots[g.group[big]]
            y, x = big[x >= 0], x[x >= 0]
            y, x = (v[g.age[x] < g.age[y]] for v in (y, x))
            ok, unlike = survive(t, e, y, x)
            best.add(y[ok], x[ok], unlike)
        best.count[best.x >= 0] += 1  # lines that the earliest settle may have other candidates
        y = np.flatnonzero(best.x < 0)
    else:
        y = np.flatnonzero(held(asked, e["id"]))
    low, high = g.windows(t, y)
    load = np.bincount(g.group[y], high - low, minlength=len(g.sizes))
    for w in np.flatnonzero(load > heavy):
        rows = slice(g.starts[w], g.starts[w] + g.sizes[w])
        wanted = np.zeros(g.sizes[w], bool)
        wanted[y[g.group[y] == w] - g.starts[w]] = True
        out.append(_crowded(_taken(e, rows), wanted, word[g.starts[w]], part))
    light = load <= heavy
    want = np.zeros(len(word), bool)
    want[y[light[g.group[y]]]] = True
    # where most lines of a word want candidates each pair is met from its shorter side, else from the lines that want any
    most = np.bincount(g.group[want], minlength=len(g.sizes)) * 2 >= g.sizes
    every, few = np.flatnonzero(most[g.group] & light[g.group]), np.flatnonzero(want & ~most[g.group])
    for a, b in itertools.chain(_ranges(every, every + 1, g.windows(t, every)[1]), _ranges(few, *g.windows(t, few))):
        ok = (g.age[a] != g.age[b]) & ((b > a) | ~want[b])
        a, b = a[ok], b[ok]
        swap = g.age[a] < g.age[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        ok = want[a]
        a, b = a[ok], b[ok]
        ok, unlike = survive(t, e, a, b)
        if asked is None:
            best.add(a[ok], b[ok], unlike)
        else:
            out.append(_found(_taken(e, a[ok]), _taken(e, b[ok]), unlike, np.zeros(len(ok), bool), word[a[ok]]))
    y = np.flatnonzero(best.x >= 0)
    out.append(_found(_taken(e, y), _taken(e, best.x[y]), best.unlike[y], best.count[y] > 1, word[y]))
    return pa.concat_tables(out)


def _cross(t: Threshold, one: Columns, other: Columns, word: int, everything: bool) -> pa.Table:
    """What lines of one part of a word, as far as they want candidates, find in another part."""
    both = {k: np.concatenate((one[k], other[k])) for k in one}
    age, n = _ages(both), both["n"].astype(np.int64)
    y = np.flatnonzero(one["key"] == 1)
    x = len(one["key"]) + np.argsort(other["n"], kind="stable")
    low, high = np.searchsorted(n[x], -(-n[y] * t.num // t.den)), np.searchsorted(n[x], n[y] * t.den // t.num, "right")
    best, out = _Best(len(age)), []
    for a, b in _ranges(y, low, high):
        b = x[b]
        ok = age[b] < age[a]
        a, b = a[ok], b[ok]
        ok, unlike = survive(t, both, a, b)
        best.add(a[ok], b[ok], unlike)
        if everything:
            out.append(_found(_taken(both, a[ok]), _taken(both, b[ok]), unlike, np.zeros(len(ok), bool), np.full(len(ok), word)))
    y = np.flatnonzero(best.x >= 0)
    out.append(_found(_taken(both, y), _taken(both, best.x[y]), best.unlike[y], np.ones(len(y), bool), np.full(len(y), word)))
    return pa.concat_tables(out)


def _candidates(t: Threshold, posted: DataFrame, tag: str, asked: np.ndarray | None = None, heavy: int = HEAVY, part: int = PART, large: int = LARGE) -> DataFrame:
    """(y, y_doc, y_place, x, x_doc, x_place, unlike, more, word): what the lines that share a word of a bucket find there.

    The places of a line are those of its earliest posting, the same for every word of its prefix.
    """

    def meet(group: pa.Table) -> pa.Table:
        return _meet(t, group.column("bucket")[0].as_py(), _unpacked(group.column("postings").to_pylist()), asked, heavy, part, large)

    def cross(group: pa.Table) -> pa.Table:
        blobs = dict(zip(group.column("part").to_pylist(), group.column("postings").to_pylist(), strict=True))
        i, j, word = (group.column(c)[0].as_py() for c in ("i", "j", "word"))
        parts = {k: _unpacked([blobs[k]]) for k in {i, j}}
        return pa.concat_tables([_cross(t, parts[a], parts[b], word, asked is not None) for a, b in {(i, j), (j, i)}])

    met = materialize(posted.groupBy("bucket").applyInArrow(meet, FOUND), tag)
    found = met.where("postings is null")
    crowded = met.where("postings is not null").select("word", "part", "parts", "postings")
    if not crowded.isEmpty():
        both = crowded.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o")})
        found = found.union(materialize(both.groupBy("word", "i", "j").applyInArrow(cross, FOUND), tag))
    return found.drop("part", "parts", "postings")


def _verified(pairs: DataFrame, source: DataFrame, t: Threshold, least: int) -> DataFrame:
    """The ids y of the pairs, a materialised table, whose sets reach the threshold; one pass over the documents of the lines concerned gives their sets."""
    lines = pairs.select(*[F.col(f"y{c}").alias(f"l{c}") for c in ("", "_doc", "_place")]).union(pairs.select("x", "x_doc", "x_place")).distinct()
    n = 2 * pairs.count()
    wanted, documents = filter_of(lines, n), filter_of(lines.select("l_doc"), n)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch.filter(pa.array(held(documents, batch.column(0).to_numpy())))]):
                row, place, ids, n, tokens = compared(part, least)
                ok = held(wanted, ids, part.column(0).to_numpy()[row], place)
                raw = np.ascontiguousarray(tokens[np.repeat(ok, n)].view(np.uint8).reshape(-1, 8)[:, :BYTES])
                ends = (np.concatenate(([0], np.cumsum(n[ok]))) * BYTES).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, pa.py_buffer(ends), pa.py_buffer(raw)])], ["id", "elements"])

    def unpack(x: bytes) -> np.ndarray:
        out = np.zeros((len(x) // BYTES, 8), np.uint8)
        out[:, :BYTES] = np.frombuffer(x, np.uint8).reshape(-1, BYTES)
        return out.view(np.uint64).ravel()

    return verified(pairs.select("y", "x"), source.mapInArrow(sets, "id long, elements binary"), t, unpack).select(F.col("y").alias("id")).distinct()


def _posted(source: DataFrame, t: Threshold, least: int, ranks: tuple[np.ndarray, np.ndarray], words: np.ndarray | None = None) -> DataFrame:
    """(bucket, postings) of the prefixes of all lines, or of their words in a filter only."""
    n_buckets = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Postings(t, n_buckets, ranks[1], words)
        for part in chunks(batches):
            row, place, _, n, tokens = compared(part, least, ranks)
            kept.add(n, tokens, part.column(0).to_numpy()[row], place)
            if kept.size >= FLUSH:
                yield kept.flush()
        if kept.size:
            yield kept.flush()

    return source.mapInArrow(post, "bucket long, postings binary")


def duplicates(docs: DataFrame, threshold: Threshold = THRESHOLD, min_tokens: int = MIN_TOKENS, **limits) -> DataFrame:
    """(doc_id, places): the 0-based places of the lines that go, of each document that loses any.

    Lines of fewer than ``min_tokens`` different words stay.  Words are compared by 48-bit
    hashes, lines that count as equal by 128 bits of their sets.
    """
    t = threshold
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "place", "id", "check", "task", "piece", "bytes"]

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for b in chunks(batches):
            row, place, ids, n, tokens = compared(b, min_tokens)
            counts += np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[row]), pa.array(place), pa.array(ids), pa.array(fingerprints(mix(tokens), n)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(PIECES, pa.int64())] * 4 + pieces(counts), names)

    written = materialize(source.mapInArrow(outline, "doc_id long, place long, id long, check long, task int, piece int, bytes binary"), "lines")
    counts = summed(written.where("piece is not null").select("task", "piece", "bytes"), np.int64, sum)
    counts = np.zeros(CELLS, np.int64) if counts is None else counts
    cell = np.argsort(counts, kind="stable").astype(np.uint64)
    rank = np.empty(CELLS, np.uint64)
    rank[cell.astype(np.int64)] = np.arange(CELLS, dtype=np.uint64)
    ranks = rank, cell
    lines = written.where("piece is null").select("doc_id", "place", "id", "check")

    # a set of n words has no match but its equals unless n / (n + 1) reaches the threshold
    least = max(min_tokens, -(-t.num // max(1, t.den - t.num)))
    found = _candidates(t, _posted(source, t, least, ranks), "met", **limits)
    likest = F.min(F.struct("unlike", "x", "x_doc", "x_place")).alias("b")
    star = found.groupBy("y").agg(*[F.min(c).alias(c) for c in ("y_doc", "y_place")], likest, F.max("more").alias("more"), F.min("x").alias("x1"), F.max("x").alias("x2"))
    star = materialize(star.select("y", "y_doc", "y_place", *[F.col(f"b.{c}").alias(c) for c in ("x", "x_doc", "x_place")], (F.col("more") | (F.col("x1") != F.col("x2"))).alias("more")), "star")
    hit = materialize(_verified(star, source, t, min_tokens), "hit")

    # the lines whose candidate failed and that had others are searched again, by the words under which they had any
    left = materialize(star.where("more").join(hit.withColumnRenamed("id", "y"), "y", "left_anti").select("y"), "left")
    again = None
    if not left.isEmpty():
        asked = filter_of(left, left.count())
        words = filter_of(found.join(left, "y", "left_semi").select("word").distinct())
        rest = _candidates(t, _posted(source, t, least, ranks, words), "met", asked, **limits)
        rest = rest.join(left, "y", "left_semi").groupBy("y", "x").agg(*[F.min(c).alias(c) for c in ("y_doc", "y_place", "x_doc", "x_place")])
        rest = materialize(rest.join(star.select("y", "x"), ["y", "x"], "left_anti"), "rest")
        again = materialize(_verified(rest, source, t, min_tokens), "hit")

    gone_ids = (hit if again is None else hit.union(again).distinct()).withColumn("gone", F.lit(True))
    first = lines.groupBy("id", "check").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("copies"))
    loses = first.join(gone_ids, "id", "left").where("copies > 1 or gone")
    gone = lines.join(loses, ["id", "check"]).where("gone or struct(doc_id, place) > first")
    out = materialize(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("places")), "places")
    discard(written, star, hit, left, *([] if again is None else [rest, again]))
    return out


def dedup(docs: DataFrame, threshold: Threshold = THRESHOLD, min_tokens: int = 1) -> DataFrame:
    """The documents without repeated lines, with n_lines and n_removed (both long).

    ``text`` is replaced, and ``n_chars`` if it is there; a text that loses all its lines is
    empty.  Null and empty texts and lines without words stay as they are.  A null id counts as the least.  Rows
    that repeat an id are at the same place, so neither's lines are earlier than the
    other's same lines, and a line goes from both or none; an empty table gives an empty
    result; other columns are carried, but n_lines and n_removed are replaced.
    """
    gone = duplicates(docs, threshold, min_tokens).select(F.col("doc_id").alias("_key"), F.col("places").alias("_places"))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, lost in zip(texts, places, strict=True):
            if lost is not None and text is not None:
                lines = text.split("\n")
                keep = np.ones(len(lines), bool)
                keep[np.asarray(lost)] = False
                text = "\n".join(x for x, ok in zip(lines, keep.tolist(), strict=True) if ok)
            out.append(text)
        return pd.Series(out, dtype=object)

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    # most documents lose lines, so both sides are dealt out at every size; the places, which are small, are hashed, and no text is sorted
    d = docs.drop("n_lines", "n_removed").join(gone.hint("shuffle_hash"), key == F.col("_key"), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    n_removed = F.when(F.col("_key").isNull() | F.col("text").isNull(), 0).otherwise(F.size("_places")).cast("long")
    d = d.withColumns({"n_lines": n_lines, "n_removed": n_removed, "text": kept(F.col("text").cast("string"), "_places")})
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.drop("_key", "_places")
