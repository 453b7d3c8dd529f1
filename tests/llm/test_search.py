"""Ranked lexical search and exact top-k search against brute force, and on awkward tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fusegrid.llm import lexical, metric

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    """(item, rank, doc, score) by definition; docs and items are (id, text)."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    texts = defaultdict(set)
    for i, t in items:
        texts[i].add(t)
    out = []
    for i, ts in texts.items():
        asks = Counter(x for t in ts for x in terms(t))
        found = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(f * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, f in asks.items() if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k]) if i is not None]
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("item_id", "term", "score", "part", "rank", "lang")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("doc_id", "term", "times", "score")})
    return sorted(map(tuple, lexical.search(d.repartition(5), i, **options).collect()), key=str)


def test_lexical_search_equals_its_definition(spark):
    rng = random.Random(5)
    words = ["the", "The", "été", "漢字", "x1", "a-b", "snake_case", "İstanbul", "naïve", "z"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(150)]
    docs += [(7, docs[7][1]), (None, docs[7][1]), (None, None), (200, ""), (201, "-- !! \x00"), (202, "w1 " * 50_000), (2**62, docs[9][1])]
    items = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(20)]
    items += [(3, items[3][1]), (4, "w9 w9 unseen"), (50, None), (51, ""), (52, "unseen"), (None, "w1 w2"), (53, "w2 " * 30_000 + "z")]
    want = ranked(docs, items)
    assert searched(spark, docs, items) == want and len(want) > 150
    assert searched(spark, docs, items, item_entries=40) == want  # several blocks of items
    assert searched(spark, docs, items, k=1) == ranked(docs, items, 1)


def test_lexical_search_over_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == searched(spark, [(1, "a")], []) == searched(spark, [], []) == []
    assert searched(spark, [(1, None), (2, " ")], [(1, "a")]) == []


def test_equal_scores_are_cut_by_id(spark):
    docs = [(1000 - i, "one two three") for i in range(300)] + [(5000, "none of it")]
    assert [r[2] for r in sorted(searched(spark, docs, [(1, "two")]), key=lambda r: r[1])] == list(range(701, 711))


def test_terms_do_not_depend_on_pieces():
    texts = ["Ab cd_ef  gh", None, "", "x" * 50 + " y", "é1 é2 " * 9, "-"]
    whole = [(int(h), int(r)) for hs, rows in lexical.terms_of(pa.array(texts)) for h, r in zip(hs, rows, strict=True)]
    assert [r for _, r in whole] == [i for i, t in enumerate(texts) for _ in terms(t)]
    for piece in (1, 3, 7, 20):
        assert [(int(h), int(r)) for hs, rows in lexical.terms_of(pa.array(texts), piece) for h, r in zip(hs, rows, strict=True)] == whole


def test_impacts_beyond_64_bits():
    tf = np.array([[0, 0, 3]])
    got = lexical.impacts(tf, np.array([10**9]), np.array([2]), 10**11, 10**13)
    assert got.tolist() == [2 * (3 * 10**9 // (3000 + 8 * (25 + 75 * 10**9 * 10**11 // 10**13)))]


def brute(rows, queries, k):
    """rows and queries are (id, list of whole numbers)."""
    out = []
    for q in sorted({i for i, _ in queries}):
        best = {}
        for n, (i, v) in enumerate(rows):
            for j, w in queries:
                if j == q and i != q and len(v) == len(w):
                    s = sum(a * b for a, b in zip(v, w, strict=True))
                    best[n] = max(best.get(n, s), s)
        near = sorted((-s, rows[n][0]) for n, s in best.items())[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def vectors(rng):
    rows = [(i, rng.integers(-60, 60, 6).tolist()) for i in range(400)]
    rows += [(1000 + i, [5, 5, 5, 0, 0, -9]) for i in range(200)]  # a third are equal
    rows += [(3, rows[3][1]), (3, rows[8][1]), (17, rows[17][1]), (2**62, [0] * 6), (2000, [2**30, -(2**30), 1, 2, 3, 4]), (2001, [2**30, -(2**30), 1, 2, 3, 5])]
    return rows + [(3000 + i, [i, 1]) for i in range(7)] + [(3100, []), (3150, [])]


def test_metric_search_equals_brute_force(spark):
    rows = vectors(np.random.default_rng(3))
    d = spark.createDataFrame([*rows, (None, [1] * 6), (5000, None), (5050, [1, None, 1, 1, 1, 1])], "vec_id long, vector array<long>")
    d = d.withColumns({c: F.lit("clash") for c in ("uid", "pivot", "part", "block", "score", "rank", "bound")})
    queries = [(i, v) for i, v in rows if i % 50 == 0 or i in (3, 3001)]
    q = d.where("vec_id % 50 = 0 or vec_id in (3, 3001)")
    for chunk, block, k, leaf in ((8192, 8192, 5, 16), (64, 3, 5, 1024), (100, 50, 1, 7), (200, 8192, 700, 1)):
        got = sorted(map(tuple, metric.search(d.repartition(4), q, k, chunk, block, leaf).collect()))
        assert got == brute(rows, queries, k)


def test_metric_search_over_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, vector array<long>")
    some = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, vector array<long>")
    assert metric.search(none, none).collect() == metric.search(some, none).collect() == metric.search(none, some).collect() == []
    assert sorted(map(tuple, metric.search(some, some).collect())) == [(0, 1, 1, 11), (1, 1, 0, 11)]


def test_fixed_point_leaves_out_what_is_not_a_number(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, None), (5, [-inf]), (6, [1e30]), (7, []), (8, [3.4e7] * 4), (9, [-1.0, 0.999])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", metric.fixed_point("embedding").alias("v"))
    got = {r.vec_id: r.v for r in d.collect()}
    assert got[0] == [128, -1] and got[7] == [] and got[9] == [-256, 255] and not [i for i in (1, 2, 3, 4, 5, 6, 8) if got[i] is not None]


def test_stored_distances_rule_out_most_of_clustered_rows():
    rng = np.random.default_rng(4)
    centers = rng.integers(-2000, 2000, (40, 16))
    x = (centers[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 16))).astype(float)
    longest = float((x * x).sum(1).max())
    raised = metric._raised(x, longest)
    t = metric.build(raised, 64)
    assert sorted(t.rows.tolist()) == list(range(4000))
    for p in range(len(t.first)):  # radii cover, stored distances are those to the parent
        for e in range(t.first[p], t.first[p] + t.count[p]):
            far = np.linalg.norm(raised[t.rows[e if t.leaf[p] else t.center[e]]] - raised[t.rows[t.center[p]]])
            assert abs(far - (t.row_apart if t.leaf[p] else t.apart)[e]) < 1e-6 * longest**0.5
    asked = []
    for i in range(0, 4000, 100):
        square = float(x[i] @ x[i]) + longest
        rows, score, n = metric.nearest(t, x[t.rows], t.rows.astype(np.int64), x[i], i, square, 5, np.inf, square**0.5)
        want = sorted((-(x[j] @ x[i]), j) for j in range(4000) if j != i)[:5]
        assert sorted(zip((-score).tolist(), t.rows[rows].tolist(), strict=True)) == want
        asked.append(n)
    assert np.mean(asked) < 0.35 * 4000
