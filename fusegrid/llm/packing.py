"""Packing documents into sequences of a fixed token capacity, balanced by attention cost.

Each task packs the documents of its own input split in pools of bounded size, so
nothing is shuffled and nothing is gathered: a pool holds at most ``pool_tokens``
tokens and one document more.  Inside a pool the pieces go in descending order,
each to the sequence of lowest estimated cost (linear plus quadratic in the piece
lengths) that still has room for it; a piece that fits nowhere is cut along the
room that is left.  What remains at the end of a pool is laid out in sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 1
POOL_TOKENS = 1 << 21
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer(json_path: str | None, ranks_path: str | None):
    """Texts -> list of id lists, by the tokenizers library's byte-level BPE.

    The same vocabulary is also there as ranks; its faster encoder gives the same
    ids and takes the texts whose characters are all Latin letters, ASCII or common
    punctuation, where both split words alike, and that name none of the vocabulary's
    special tokens.  All other texts go to the library itself.
    """
    import public_tokenizers as P
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path or P.path("byte_bpe_50k.json"))
    with open(ranks_path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [regex.escape(x.content) for x in slow.get_added_tokens_decoder().values()]
    odd = regex.compile("|".join([r"[^\n\t\x20-\x7e¡-¬®-ɏ]", *special]))

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow.encode(t, add_special_tokens=False).ids if odd.search(t) else fast.encode_ordinary(t) for t in texts]

    return encode


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack_pool(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for every piece of the given documents.

    Sequences are numbered from 0; every token lies in exactly one piece and every
    offset run is gapless.  All sequences but those of a power-of-two length are full.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sequence, rest = 0, []
    for doc, n in enumerate(lengths.tolist()):
        whole = n // capacity
        out += [(doc, k * capacity, capacity, sequence + k, 0) for k in range(whole)]
        sequence += whole
        if n % capacity:
            rest.append((n % capacity, doc, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(n for n, _, _ in rest)
    rooms = [capacity] * (total // capacity)
    tail = total % capacity
    rooms += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if tail >> b & 1]
    room, spent, used = np.array(rooms, np.int64), np.zeros(len(rooms)), np.zeros(len(rooms), np.int64)
    for n, doc, start in rest:
        while n:
            open_ = np.flatnonzero(room >= n)
            # an unfitting piece is cut: the largest room takes what it holds
            at = open_[np.argmin(spent[open_])] if len(open_) else int(np.argmax(room))
            take = min(n, int(room[at]))
            out.append((doc, start, take, sequence + int(at), int(used[at])))
            room[at] -= take
            used[at] += take
            spent[at] += cost(take)
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from (doc_id, start, length, doc_tokens) and lies (sequence_id, offset).

    ``with_ids`` adds the piece's token ids.  A null text is empty and has only the end
    id; a null id stays null; rows that repeat an id are separate documents; a text of
    any length is cut into pieces; an empty table has no pieces; other columns are not read.
    ``sequence_id`` is unique over the result: the partition's number times 2**32, plus a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(json_path, ranks_path)
        first = TaskContext.get().partitionId() << 32
        docs, ids, held = [], [], 0

        def flush():
            nonlocal first, held
            lengths = np.array([len(x) for x in ids], np.int64)
            pieces = pack_pool(lengths, capacity)
            if pieces:
                p = np.array(pieces, np.int64)
                p = p[np.lexsort((p[:, 4], p[:, 3]))]
                crc = [zlib.crc32(ids[d][s : s + n]) for d, s, n in p[:, :3].tolist()]
                columns = [pa.array([docs[d] for d in p[:, 0]], pa.int64()), p[:, 1], p[:, 2], np.array(crc, np.int64), lengths[p[:, 0]], p[:, 3] + first, p[:, 4]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array([ids[d][s : s + n] for d, s, n in p[:, :3].tolist()], pa.list_(pa.int32())))
                    names.append("ids")
                first += int(p[-1, 3]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)
            docs.clear()
            ids.clear()
            held = 0

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for d, x in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    docs.append(d)
                    ids.append(np.array([*x, end_id], "<i4"))
                    held += len(x) + 1
                    if held >= pool_tokens:
                        yield from flush()
        yield from flush()

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
