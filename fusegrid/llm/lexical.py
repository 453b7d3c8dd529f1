"""Ranked lexical search as a blocked sparse matrix product.

Scores are A x B: A holds how often an item has a term, B the int64 impact of a term in a
document.  B comes in blocks of documents, cut from an input split as it streams by, in rows by
term.  The product goes row by row (Gustavson): an item's row is the merge of B's rows of
the item's terms, each added to one dense accumulator of the block's documents.  A block gives each
item's k best; a task merges those of its blocks, and windows in two steps those of tasks.

Documents are read twice: for the counts (N, L and the terms' document counts), and for the
product.  No text, posting or score of other than the best documents is shuffled.  A is cut into
blocks of about ITEM_ENTRIES entries, whose terms are sent to all tasks; a larger
table of items takes a pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.llm.words import buffers, words_of

#: Entries (item, term) of one block of items; about 16 bytes each go to every task.
ITEM_ENTRIES = 1 << 20
#: Bytes of text counted at once, and those from which a block of documents is multiplied.
PIECE_BYTES, BLOCK_BYTES = 1 << 21, 1 << 24
#: Bytes that no term holds: all of ASCII but letters and digits.
GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BIG = np.iinfo(np.int64).max


def _cuts(data: np.ndarray, piece: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``piece`` bytes that end between terms, also inside a long text."""
    at = 0
    while at < len(data):
        end = at + piece
        while end < len(data):
            ahead = np.flatnonzero(GAPS[data[end : end + piece]])
            if len(ahead):
                end += int(ahead[0])
                break
            end += piece
        end = min(end, len(data))
        yield at, end
        at = end


def terms_of(texts: pa.Array, piece: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of every term of a string column, in pieces; A-Z count as a-z, nulls have none.

    Hashes have 64 bits: two different terms count as one with a chance of 2**-64.
    """
    data, offsets = buffers(texts)
    for a, b in _cuts(data, piece):
        first = max(int(np.searchsorted(offsets, a, "right")) - 1, 0)
        last = int(np.searchsorted(offsets, b, "left"))
        h, _, row = words_of(data[a:b], np.clip(offsets[first : last + 1], a, b) - a, lower=True, gaps=GAPS)
        yield h, row + first


@dataclass(frozen=True)
class Items:
    """A block of A: items in rows, terms by the place of their hash in ``terms``, which is sorted."""

    ids: np.ndarray
    starts: np.ndarray
    term: np.ndarray
    times: np.ndarray
    terms: np.ndarray

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in ``terms``, or -1."""
        at = np.minimum(np.searchsorted(self.terms, h), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == h, at, -1) if len(self.terms) else np.full(len(h), -1)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: A, an entry a row; the different texts of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for h, row in terms_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(h.view(np.int64))], ["item_id", "term"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    return texts.mapInArrow(run, "item_id long, term long").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def item_blocks(entries: DataFrame, most: int) -> Iterator[Items]:
    """Blocks of whole items of about ``most`` entries, one at a time."""
    n = max(1, -(-entries.count() // most))
    for i in range(n):
        block = entries if n == 1 else entries.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        t = block.toArrow()
        item, term, times = (t.column(c).to_numpy() for c in ("item_id", "term", "times"))
        term = term.view(np.uint64)
        order = np.lexsort((term, item))
        ids, starts = np.unique(item[order], return_index=True)
        terms, at = np.unique(term[order], return_inverse=True)
        yield Items(ids, np.append(starts, len(item)), at, times[order].astype(np.int64), terms)


def counts(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """(N, L, document count of each term of the block) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, some = np.zeros(len(items.terms), np.int64), 0, 0
        for batch in batches:
            for part in _parts(batch):
                tf, n = _matrix([part.column(1)], items)
                df += np.bincount(tf[:, 1], minlength=len(df))
                total += int(n.sum())
                some += int((n > 0).sum())
        held = np.flatnonzero(df)
        keys, values = np.concatenate((held, [-1, -2])), np.concatenate((df[held], [some, total]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["k", "v"])

    got = docs.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    held = dict(zip(got.column("k").to_pylist(), got.column("v").to_pylist(), strict=True))
    return held.get(-1, 0), held.get(-2, 0), np.array([held.get(i, 0) for i in range(len(items.terms))], np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about BLOCK_BYTES of text."""
    _, offsets = buffers(batch.column(1))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _matrix(texts: list[pa.Array], items: Items) -> tuple[np.ndarray, np.ndarray]:
    """((document, term, occurrences) in order of (term, document), terms of each document) of a block."""
    found, n, base = [], np.zeros(sum(map(len, texts)), np.int64), 0
    for column in texts:
        for h, row in terms_of(column):
            n[base : base + len(column)] += np.bincount(row, minlength=len(column))
            at = items.places(h)
            hit = at >= 0
            key, times = np.unique(at[hit] * len(n) + row[hit] + base, return_counts=True)
            found.append((key, times))
        base += len(column)
    if not found:
        return np.zeros((0, 3), np.int64), n
    key, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    times = np.zeros(len(key), np.int64)
    np.add.at(times, inverse, np.concatenate([t for _, t in found]))
    return np.stack((key % max(len(n), 1), key // max(len(n), 1), times), 1), n


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """B's entries: weight * ((10**9 * tf) div (1000 * tf + 8 * m)), m = 25 + (75 * n * N) div L."""
    if n_terms and 75 * int(n.max(initial=0)) * n_docs > _BIG:  # beyond 64 bits: in whole numbers of any size
        m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 25 + 75 * n * n_docs // max(n_terms, 1)
    return weight[tf[:, 1]] * (10**9 * tf[:, 2] // (1000 * tf[:, 2] + 8 * m[tf[:, 0]]))


def product(items: Items, tf: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item's row, scores of the block's documents): for each item the merge of the rows of its terms."""
    starts = np.searchsorted(tf[:, 1], np.arange(len(items.terms) + 1))
    doc, total = tf[:, 0], np.zeros(n_docs, np.int64)
    for i in range(len(items.ids)):
        total[:] = 0
        for e in range(items.starts[i], items.starts[i + 1]):
            a, b = starts[items.term[e]], starts[items.term[e] + 1]
            total[doc[a:b]] += items.times[e] * impact[a:b]  # a row names a document once
        yield i, total


def _best(score: np.ndarray, doc: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: the highest score, then the smallest id, null ids last."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((doc[at], ~known[at], -score[at]))[:k]]


FOUND = "item_id long, doc_id long, score long, part int"


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """The k best documents of each item in each task."""
    n_docs, n_terms, df = counts(docs, items)
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}

        def multiply(held: list[pa.RecordBatch]) -> None:
            tf, n = _matrix([b.column(1) for b in held], items)
            ids = pa.concat_arrays([b.column(0) for b in held])
            doc, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            for i, score in product(items, tf, impacts(tf, n, weight, n_docs, n_terms), len(n)):
                at = _best(score, doc, known, k)
                new = (score[at], doc[at], known[at])
                if i in best:
                    new = tuple(np.concatenate(x) for x in zip(best[i], new, strict=True))
                    at = _best(*new, k)
                    new = tuple(x[at] for x in new)
                best[i] = new

        held, size = [], 0
        for batch in batches:
            for part in _parts(batch):
                held.append(part)
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    multiply(held)
                    held, size = [], 0
        if held:
            multiply(held)
        part = TaskContext.get().partitionId()
        for i, (score, doc, known) in best.items():
            n = len(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, items.ids[i])), pa.array(doc, mask=~known), pa.array(score), pa.array(np.full(n, part, np.int32))], ["item_id", "doc_id", "score", "part"])

    return docs.mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_entries: int = ITEM_ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0.

    Documents have doc_id and text, items item_id and text; other columns are not read.  Null and empty texts
    have no term: such a document is not counted, such an item finds nothing.  Each row is a document of its own, so repeated rows are
    ranked one by one; a null doc_id stays null and comes last among equal scores.  The different
    texts of one item_id are one item, rows that repeat one count once, and items without an id
    find nothing.  A text of any length is counted in pieces; empty tables give no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(item_terms(items), item_entries):
        found = _search(source, block, k) if len(block.ids) else docs.sparkSession.createDataFrame([], FOUND)
        out = found if out is None else out.union(found)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    groups = F.floor(F.sqrt(F.col("part")))
    first = out.withColumn("rank", F.row_number().over(W.partitionBy("item_id", groups).orderBy(*order))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
