"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a
bounded sample of labelled documents, and labels every byte position of a text; a
document's probabilities are the mean of its positions'.  Whole texts are labelled:
windows of ``WINDOW`` bytes cover each of them, and all windows of a batch advance
one position at a time together.
"""

from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.words import buffers

HIDDEN, WINDOW, LANES = 8, 256, 4096
#: The training sample: this many documents of each language at most, chosen by hash, one window of each.
SAMPLE = 512
STEPS, BATCH, SPAN, RATE = 240, 192, 64, 0.02
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass
class Model:
    """Gate tables by byte (3H, 256) and recurrent weights (3H, H) of each direction; the output layer."""

    langs: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    w: np.ndarray
    c: np.ndarray


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


def _step(x: np.ndarray, u: np.ndarray, b: np.ndarray, h: np.ndarray):
    """One gated recurrent step for all lanes: gates z, r, candidate n, its recurrent part q, the new state."""
    k = h.shape[0]
    a, g = np.take(x, b, axis=1), u @ h
    zr = _sigmoid(a[: 2 * k] + g[: 2 * k])
    z, r, q = zr[:k], zr[k:], g[2 * k :]
    n = np.tanh(a[2 * k :] + r * q)
    return z, r, n, q, n + z * (h - n)


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(0))
    return e / e.sum(0)


def train(windows: list[bytes], labels: list[str], seed: int = 5, steps: int = STEPS) -> Model:
    """Adam on the mean cross-entropy of all positions, languages drawn evenly."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    h, f = HIDDEN, np.float32
    model = Model(langs, [rng.normal(0, 0.3, (3 * h, 256)).astype(f) for _ in "ab"], [rng.normal(0, 0.35, (3 * h, h)).astype(f) for _ in "ab"], rng.normal(0, 0.3, (len(langs), 2 * h)).astype(f), np.zeros((len(langs), 1), f))
    rows = [np.frombuffer(w.ljust(SPAN, b" "), np.uint8) for w in windows]
    by = [np.flatnonzero(np.array(labels) == x) for x in langs]
    params = [*model.x, *model.u, model.w, model.c]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        y = rng.integers(0, len(langs), BATCH)
        pick = [by[k][rng.integers(len(by[k]))] for k in y]
        text = np.stack([rows[i][(s := rng.integers(0, len(rows[i]) - SPAN + 1)) : s + SPAN] for i in pick])
        rate = RATE * (1 - t / (steps + 1))
        for p, g, m, v in zip(params, _gradients(model, text.T, y), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(f)
    return model


def _gradients(model: Model, text: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of x, u, w, c by backpropagation through time; text: (positions, lanes)."""
    span, lanes = text.shape
    k, orders = HIDDEN, (range(span), range(span - 1, -1, -1))
    states, kept = np.zeros((2, span, k, lanes), np.float32), [{}, {}]
    for d, order in enumerate(orders):
        h = np.zeros((k, lanes), np.float32)
        for t in order:
            z, r, n, q, new = _step(model.x[d], model.u[d], text[t], h)
            kept[d][t] = (z, r, n, q, h)
            states[d, t] = h = new
    both = np.concatenate((states[0], states[1]), 1)
    p = _softmax(np.einsum("lk,tkn->ltn", model.w, both) + model.c[:, :, None])
    p[y, :, np.arange(lanes)] -= 1
    p /= span * lanes
    dw, dc = np.einsum("ltn,tkn->lk", p, both), p.sum((1, 2))[:, None]
    dboth = np.einsum("lk,ltn->tkn", model.w, p)
    dx, du = [], []
    for d, order in enumerate(orders):
        dh, gates, g_u = np.zeros((k, lanes), np.float32), np.zeros((3 * k, span, lanes), np.float32), np.zeros_like(model.u[d])
        for t in reversed(order):
            z, r, n, q, h = kept[d][t]
            dh = dh + dboth[t, d * k : (d + 1) * k]
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr = dh * (h - n) * z * (1 - z), dn * q * r * (1 - r)
            gates[:, t] = np.concatenate((dz, dr, dn))
            dg = np.concatenate((dz, dr, dn * r))
            g_u += dg @ h.T
            dh = dh * z + model.u[d].T @ dg
        flat = text.ravel()
        dx.append(np.stack([np.bincount(flat, g.ravel(), 256) for g in gates]).astype(np.float32))
        du.append(g_u)
    return [*dx, *du, dw, dc]


def label(model: Model, text: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """Sums of the position probabilities (languages, lanes); text: (positions, lanes); dead positions count nothing."""
    span, lanes = text.shape
    k = HIDDEN
    back, h = np.empty((span, k, lanes), np.float32), np.zeros((k, lanes), np.float32)
    for t in range(span - 1, -1, -1):
        h = _step(model.x[1], model.u[1], text[t], h)[4]
        if live is not None:
            h *= live[t]
        back[t] = h
    h, out = np.zeros((k, lanes), np.float32), np.zeros((len(model.langs), lanes), np.float32)
    for t in range(span):
        h = _step(model.x[0], model.u[0], text[t], h)[4]
        p = _softmax(model.w[:, :k] @ h + model.w[:, k:] @ back[t] + model.c)
        out += p if live is None else p * live[t]
    return out


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages): mean position probabilities of whole texts given as (bytes, offsets)."""
    size = np.diff(offsets)
    full = size // WINDOW
    doc = np.repeat(np.arange(len(size)), full)
    at = offsets[:-1][doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full))
    rest = np.flatnonzero(size % WINDOW)
    jobs = [(doc, at, np.full(len(doc), WINDOW))]
    rest = rest[np.argsort(size[rest] % WINDOW, kind="stable")]  # windows of about the same length advance together
    jobs.append((rest, offsets[rest] + full[rest] * WINDOW, size[rest] % WINDOW))
    out = np.zeros((len(size), len(model.langs)))
    for docs, starts, lengths in jobs:
        for s in range(0, len(docs), LANES):
            d, a, n = docs[s : s + LANES], starts[s : s + LANES], lengths[s : s + LANES]
            step = np.arange(n.max())[:, None]
            text = data[np.minimum(a[None] + step, len(data) - 1)]
            sums = label(model, text, None if n.min() == n.max() else (step < n[None]).astype(np.float32))
            for j in range(len(model.langs)):
                out[:, j] += np.bincount(d, sums[j], len(size))
    return out / np.maximum(size, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learnt: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model | None:
    """A model of the non-null ``lang`` values of documents that are not held out; None if there are none.

    The sample is bounded: of each language the documents with the least hash in each of
    ``sample`` buckets, and of each document one window at a pseudorandom place.
    """
    d = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    d = d.withColumn("h", F.xxhash64("doc_id"))
    chosen = d.groupBy("lang", F.pmod("h", F.lit(sample)).alias("b")).agg(F.min("h").alias("h")).select("lang", "h")
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1
    got = d.join(F.broadcast(chosen), ["lang", "h"]).where("text is not null").select("lang", "h", F.substring("text", place.cast("int"), F.lit(WINDOW)).alias("w"))
    got = got.groupBy("lang", "h").agg(F.min("w").alias("w")).toPandas().sort_values(["lang", "h"])
    got = got[[bool(_LETTER.search(x)) for x in got.w]]
    return train([x.encode() for x in got.w], list(got.lang), seed) if len(got) else None


_LETTER = regex.compile(r"\p{L}")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document from its text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if
    nothing could be learnt.  The score is the mean position probability of the predicted
    language; ties go to the first language by name.  Rows that repeat an id are
    labelled one by one; texts of any length are labelled whole; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            known = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
            langs, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if model is not None and known.any():
                p = probabilities(model, *buffers(texts))
                best = p.argmax(1)
                langs[known] = np.array(model.langs, object)[best[known]]
                score[known] = np.clip(p[np.arange(len(p)), best], 0, 1)[known]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model fitted to these documents."""
    p = predict(docs, fit(docs, **options))
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: A document is rejected if no language reaches this mean probability.
LEAST_SCORE = 0.3


def keep_known(docs: DataFrame, least: float = LEAST_SCORE, **options) -> DataFrame:
    """The documents, unchanged, whose text has a language: not ``und``, and a score of ``least`` or more."""
    model = fit(docs, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            ok = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
            if model is not None and ok.any():
                ok &= probabilities(model, *buffers(texts)).max(1) >= least
            yield batch.filter(pa.array(ok if model is not None else np.zeros(len(ok), bool)))

    return docs.mapInArrow(run, docs.schema)
