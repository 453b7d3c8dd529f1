"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fusegrid.llm import ann, chat, html, langid, linededup, media, mixing, ngramjoin, packing, queries, setjoin, urlfilter
from fusegrid.llm.setjoin import Threshold
from fusegrid.llm.words import buffers, shingles_of, words_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def awkward(spark, extra=()):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    long = "lang lang of the words that go on and on\n" * 3000
    rows = [(1, "the of and to in a line of words here", "en", "a", 30), (1, "the of and to in a line of words here", "en", "a", 30), (2, None, None, None, None), (3, "", "de", "b", 0), (4, long, "en", "a", 5), (None, "the of and to in a line of words here", None, "b", 1), (5, "the of and to in a line of words here!", "fr", None, 2), (6, "\n\n \t\n", "en", "b", 3), (7, "12 34 !!", "en", "b", 3), (8, "été ß ñ 漢字 <|endoftext|> \u00ad", "fr", "c", 3), *extra]
    d = spark.createDataFrame(rows, DOCS)
    for c in ("n", "id", "key", "size", "block", "h", "token", "place", "c", "words", "copy", "target", "uid", "score", "places"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingle_set(text, width):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width, num, den):
    sets = [(d, shingle_set(t, width)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, (_, s) in enumerate(sets):
        both = Counter(j for g in s for j in holders.get(g, ()))
        for j, k in both.items():
            if den * k >= num * (len(s) + len(sets[j][1]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def brute_lines(rows, least=5, num=4, den=5):
    lines = [(d, i, frozenset(WORD.findall(x))) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    lines = sorted((x for x in lines if len(x[2]) >= least), key=lambda x: x[:2])
    holders, gone = {}, {}
    for k, (d, i, s) in enumerate(lines):
        both = Counter(j for w in s for j in holders.get(w, ()) if lines[j][:2] < (d, i))
        if any(den * v >= num * (len(s) + len(lines[j][2]) - v) for j, v in both.items()):
            gone.setdefault(d, set()).add(i)
        for w in s:
            holders.setdefault(w, []).append(k)
    return {d: sorted(v) for d, v in gone.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\n\t 漢x1", max_size=60)), max_size=8))
def test_words_equal_the_pattern(texts):
    h, start, row = words_of(*buffers(pa.array(texts, pa.string())), lower=True)
    want = [(r, w) for r, t in enumerate(texts) for w in WORD.findall(lower(t or ""))]
    assert row.tolist() == [r for r, _ in want]
    names = {}
    assert all(names.setdefault(w, x) == x for (_, w), x in zip(want, h.tolist(), strict=True)) and len(set(names.values())) == len(names)
    _, _, n = shingles_of(h, row, len(texts), 3)
    assert n.tolist() == [len(shingle_set(t, 3)) for t in texts]


def near_sets(rng, t, count=60):
    """Random sets with planted neighbours around the threshold."""
    out = []
    for _ in range(count):
        base = rng.sample(range(4000), rng.choice([2, 3, 5, 6, 7, 8, 9, 12, 20, 45, 110]))
        out.append(frozenset(base))
        s = set(base)
        for _ in range(rng.randint(0, max(1, len(s) // 4))):
            if rng.random() < 0.5:
                s.add(rng.randrange(4000))
            elif len(s) > 1:
                s.discard(rng.choice(sorted(s)))
        out.append(frozenset(s))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("t", [Threshold(9, 10), Threshold(4, 5)])
def test_matching_sets_share_a_key(t):
    rng = random.Random(7)
    for _ in range(12):
        sets = near_sets(rng, t)
        code = {x: (x * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for x in range(4000)}
        arrays = [np.array(sorted(code[x] for x in s), np.uint64) for s in sets]
        n = np.array([len(a) for a in arrays], np.int64)
        ids = np.arange(len(sets), dtype=np.int64)
        key, owner = setjoin.keys(t, ids, n, np.concatenate(arrays))
        posted = {}
        for k, o in zip(key.tolist(), owner.tolist(), strict=True):
            posted.setdefault(o, set()).add(k)
        for i, a in enumerate(sets):
            for j in range(i):
                k = len(a & sets[j])
                if t.den * k >= t.num * (len(a) + len(sets[j]) - k) and a != sets[j]:
                    assert posted.get(i, set()) & posted.get(j, set()), (sorted(a), sorted(sets[j]))


def test_tree_finds_all_pairs_that_the_bound_admits():
    rng, t = np.random.default_rng(3), Threshold(4, 5)
    x = rng.poisson(3, (260, ngramjoin.DIMENSIONS)).astype(np.int32)
    x[130:] = x[:130] + (rng.random((130, ngramjoin.DIMENSIONS)) < 0.05)
    tree = ngramjoin.Tree(x)
    got = {frozenset((int(a), int(b))) for r, s in ngramjoin.tree_pairs(t, tree, tree) for a, b in zip(r, s, strict=True) if a != b}
    n = x.sum(1)
    over = np.minimum(x[:, None], x[None]).sum(2)
    ok = (over >= -(-4 * (n[:, None] + n[None]) // 9)) & (4 * n[:, None] <= 5 * n[None]) & (4 * n[None] <= 5 * n[:, None])
    assert got == {frozenset((int(a), int(b))) for a, b in zip(*np.nonzero(ok), strict=True) if a != b}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_ngram_join_equals_brute_force(spark, width, num, den):
    d = documents(spark)
    want = brute_components([(r.doc_id, r.text) for r in d.collect()], width, num, den)
    assert sorted(map(tuple, ngramjoin.join(d, width, Threshold(num, den)).collect()), key=str) == want


def test_ngram_join_of_many_near_copies(spark):
    """Copies of one text that differ from one another more than from it, and chains of links."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = base.copy()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(20):
        rows.append((1000 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 100))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (80, 90):
        assert sorted(map(tuple, ngramjoin.join(d, 3, Threshold(num, 100)).collect()), key=str) == brute_components(rows, 3, num, 100)


def test_ngram_join_links_over_null_ids(spark):
    rows = [(d, " ".join(f"c{k}" for k in range(at, at + 100))) for d, at in ((1, 0), (None, 4), (2, 8))]
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, Threshold(90, 100)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90, 100) and {r.component_id for r in got} == {1}


def test_ngram_join_of_awkward_rows(spark):
    d = awkward(spark)
    got = sorted(map(tuple, ngramjoin.join(d, 3, Threshold(90, 100)).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert got == brute_components(rows, 3, 90, 100)
    kept = ngramjoin.drop_copies(d.select(corpus_pipeline.COLUMNS))
    assert kept.columns == corpus_pipeline.COLUMNS and kept.where("doc_id is null").count() == 1
    assert ngramjoin.join(d.limit(0)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    d = documents(spark)
    got = {r.doc_id: list(r.places) for r in linededup.duplicates(d).collect()}
    assert got == brute_lines([(r.doc_id, r.text) for r in d.collect()])


def test_line_dedup_of_near_copies(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(300)}" for _ in range(n)] for n in (5, 7, 9, 14, 40, 90)]
    rows = []
    for i in range(60):
        text = []
        for b in rng.sample(base, 4):
            w = b.copy()
            for _ in range(rng.randint(0, max(1, len(w) // 6))):
                w[rng.randrange(len(w))] = f"y{rng.randrange(10**5)}"
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: list(r.places) for r in linededup.duplicates(d).collect()} == brute_lines(rows)


def test_line_dedup_of_awkward_rows(spark):
    d = awkward(spark)
    out = linededup.dedup(d)
    assert set(d.columns) <= set(out.columns)
    rows = {(r.doc_id, r.source): r for r in out.collect()}
    # a null id is the least, so its line is the first of those like it
    assert rows[None, "b"].text == "the of and to in a line of words here" and rows[1, "a"].text == "" and rows[1, "a"].n_removed == 1
    assert rows[2, None].text is None and rows[2, None].n_lines == 0 and rows[3, "b"].text == ""
    assert rows[4, "a"].n_removed == 2999 and out.count() == d.count()
    assert linededup.dedup(d.limit(0)).count() == 0


def test_line_dedup_with_crowded_words(spark):
    """The same lines go when large groups are settled by their earliest lines, and crowded words by pairs of parts."""
    rng, rows = random.Random(3), []
    base = [f"w{k}" for k in range(30)]
    for i in range(120):
        w = base.copy()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(30)] = f"z{rng.randrange(40)}"
        rows.append((i // 2, " ".join(w) + "\n" + " ".join(f"a{rng.randrange(9)}" for _ in range(rng.randint(4, 12)))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows, 1)
    for limits in ({"large": 2}, {"heavy": 1, "part": 7}, {"large": 3, "heavy": 50, "part": 11}):
        assert {r.doc_id: list(r.places) for r in linededup.duplicates(d, min_tokens=1, **limits).collect()} == want, limits


def test_line_dedup_of_a_long_text_that_loses_many_lines(spark):
    text = "\n".join(f"line {i % 1000}" for i in range(60000))
    got = linededup.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_lines == 60000 and got.n_removed == 59000 and got.text == "\n".join(f"line {i}" for i in range(1000))


def test_line_dedup_of_short_lines(spark):
    texts = ["menu\nshare this page\na b c d\n\n}", "share this page\nmenu\nnew line\na b c d e\n", "a a b\nb a\nx y z\nx y z w\n d c b a ", "x y z w v\nmenu menu\n}\nnew"]
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows, 1)
    out = {r.doc_id: r for r in linededup.dedup(d).collect()}
    assert {i: r.n_removed for i, r in out.items()} == {i: len(want.get(i, ())) for i in out} and want[1] == [0, 1, 3]
    assert all(r.text == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in want.get(i, ())) for i, r in out.items())
    d = documents(spark)
    want = brute_lines([(r.doc_id, r.text) for r in d.collect()], 1)
    assert {r.doc_id: list(r.places) for r in linededup.duplicates(d, min_tokens=1).collect()} == want


def exact_sequences(rows, capacity=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity and (end == capacity or end & (end - 1) == 0)
    return by_doc


def reference_ids(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_round_trip(spark):
    d = documents(spark)
    rows = packing.pack(d, with_ids=True, pool_tokens=5000).collect()
    exact_sequences(rows)
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        held = got.setdefault(r.doc_id, [])
        assert len(held) == r.start and len(r.ids) == r.length
        assert zlib.crc32(np.array(r.ids, "<i4").tobytes()) == r.ids_crc32
        held += r.ids
    assert got == {r.doc_id: reference_ids(r.text) for r in d.collect()}


def test_packing_of_awkward_rows(spark):
    rows = packing.pack(awkward(spark)).collect()
    tokens = Counter()
    for (doc, _), parts in exact_sequences(rows).items():
        tokens[doc] += sum(n for _, n in parts)
    want = Counter()
    for r in awkward(spark).collect():
        want[r.doc_id] += len(reference_ids(r.text))
    assert tokens == want
    assert packing.pack(awkward(spark).limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_pool_places_every_token_once(lengths):
    pieces = packing.pack_pool(np.array(lengths, np.int64), 16)
    for doc, n in enumerate(lengths):
        at = 0
        for _, start, length, _, _ in sorted(p for p in pieces if p[0] == doc):
            assert start == at
            at += length
        assert at == n


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    target, free, left = {}, {s: weights[i % 3] for i, s in enumerate(names)}, share * sum(sizes.values())
    while free:
        over = {s for s, w in free.items() if left * w / sum(free.values()) > most * sizes[s]}
        if not over:
            return target | {s: left * w / sum(free.values()) for s, w in free.items()}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            del free[s]
    return target


def check_mix(spark, d):
    rows = mixing.mix(d).collect()
    texts = d.collect()
    assert sorted((r.size for r in rows)) == sorted(len(WORD.findall(x.text or "")) for x in texts)
    sizes = Counter()
    for x in texts:
        sizes[x.source] += len(WORD.findall(x.text or ""))
    target, taken = brute_targets(sizes), Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    return rows, target, taken


def test_mixing_meets_its_targets(spark):
    rows, target, taken = check_mix(spark, documents(spark))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + mixing.BLOCK for s in target)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(documents(spark).repartition(5)).collect()), key=str) or {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mix(documents(spark).repartition(5)).collect()}


def test_mixing_of_awkward_rows(spark):
    check_mix(spark, awkward(spark))
    assert mixing.mix(awkward(spark).limit(0)).count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        p = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"), 5).alias("p")).collect()
        assert sorted(r.p for r in p) == list(range(n))


def test_mixed_documents_do_not_depend_on_partitions(spark):
    d = documents(spark).select(corpus_pipeline.COLUMNS)
    rows = lambda x: sorted(map(tuple, mixing.mixed_documents(x).collect()), key=str)
    assert rows(d.repartition(3)) == rows(d.repartition(7, "text"))


def test_mixed_documents_hold_the_taken_words(spark):
    d = documents(spark)
    out = mixing.mixed_documents(d)
    n = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        n[r.doc_id] += len(WORD.findall(r.text))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    held = d.select(*columns, F.xxhash64(*columns).alias("_draw"), F.monotonically_increasing_id().alias("_row"))
    taken = {r.doc_id: r.taken for r in mixing.mix(held, id_column="_row", draw_column="_draw").collect()}
    back = {r._row: r.doc_id for r in held.collect()}
    assert n == Counter({back[k]: v for k, v in taken.items() if v})


turn_text = st.text(alphabet=st.sampled_from(["#", "<", "/", "t", "u", "r", "n", ">", "\\", ":", " ", "\n", "é", "_"]), max_size=20) | st.sampled_from(["</turn>", "### user: ", "\\### Assistant: </turn> ok", "####"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(turn_text, turn_text), min_size=1, max_size=4))
def test_chat_reads_back(turns):
    done = [chat.render(*t) for t in turns]
    assert chat.parse("".join(f for f, _, _ in done)) == turns
    assert all(chat.unescape(f[s : s + n]) == t for (f, s, n), (_, t) in zip(done, turns, strict=True))


def test_chat_of_awkward_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, None, "x</turn>"), (2, None, "assistant", "# ### \\"), (2, 0, "assistant", "end")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(d)).collect()}
    sha = lambda *t: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha(("user", "a"), ("assistant", ""), ("assistant", "")) and got[1].loss_chars == 0
    assert got[None].turns_sha256 == sha(("", "x</turn>"))
    assert got[2].loss_sha256 == hashlib.sha256(b"# ### \\end").hexdigest() and got[2].loss_chars == 10
    assert chat.read_back(chat.format_turns(d.limit(0))).count() == 0
    with pytest.raises(chat.Conflict):
        chat.parse("### user: no end")


def test_chat_keeps_ids_beside_nulls(spark):
    rows = [(2**60 + 1, 0, "user", "a"), (2**60 + 2, 0, "user", "b"), (None, 0, "user", "c")]
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1))).collect()}
    assert got == {2**60 + 1: 1, 2**60 + 2: 1, None: 1}


def test_cascade_is_exact():
    rng = np.random.default_rng(4)
    h = rng.integers(-(2**63), 2**63, (2, 30000))
    listed = np.arange(30000) < 3000
    levels = urlfilter.build_levels(tuple(h[:, listed]), tuple(h[:, ~listed]))
    import pandas as pd

    c = urlfilter.Cascade(pd.DataFrame({"segment": 0, "level": range(len(levels)), "m": [len(b) for b in levels], "bits": [np.packbits(b).tobytes() for b in levels]}), 1)
    assert (c.listed(h[0], h[1], np.zeros(30000, np.int64)) == listed).all() and len(levels) > 2


def test_url_verdicts(spark):
    urls = {1: None, 2: "no scheme", 3: "http://A.Example.NET/en/x?q", 4: "http://example.net", 5: "https://x.net/y", 6: "http://badexample.net/en/", 7: "http://q.example.com/de/", 8: "http://org/fr/", 9: "http://www.ads-track.example.com/de", 10: "http://casino-win.org/fr/1", 11: "a://b://c/d#e", 12: ""}
    d = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("key", F.lit("clash"))
    for limit in (urlfilter.BROADCAST_BYTES, 0):
        got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(d, broadcast_bytes=limit).collect()}
        assert got[1] == got[2] == got[12] == ("", "", None, "allow")
        assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("example.net", "", None, "allow")
        assert got[5][2:] == got[6][2:] == ("net/", "block") and got[7][2:] == ("example.com/de/", "block") and got[8][2:] == ("org/fr/", "allow")
        assert got[9][2:] == (None, "block") and got[10][2:] == ("org/fr/", "allow") and got[11][:2] == ("b:", "//c/d")
    assert urlfilter.judge(d.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<!-- ad --><div class="ad">buy <div>now</div></div><div id="cookie-notice">we use</div><article><header>by me</header><h1>Title &amp;  more</h1><p><b>One
 two.<br><p>Three&nbsp;four &lt;b&gt;</p><aside>side</aside><form><input value="q">ask</form><section class="comments"><p>first!</p></section></article><footer>&copy; host</footer>"""


def test_html_main_text(spark):
    rows = [(1, "http://h/a/1", PAGE), (2, "http://h/a/2", PAGE.replace("One", "Uno")), (3, None, None), (4, "http://h/b", "<p>shared</p><p>own</p>"), (5, "http://h/b2", "<p>shared</p><p>other</p><p"), (6, "http://z/", ""), (7, "http://z/", "<body>loose &#233; text")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(d).collect()}
    assert got[1].text == "Title & more\nOne two.\nThree four <b>" and got[2].text.split("\n")[1] == "Uno two."
    assert (got[3].text, got[3].n_chars) == ("", 0) and got[4].text == "own" and got[5].text.startswith("other") and got[6].text == "" and got[7].text == "loose é text"
    assert html.extract(d.limit(0)).count() == 0


def test_copies_of_a_page_do_not_delete_one_another(spark):
    page = lambda own: f"<nav>menu</nav><p>every page</p><p>{own}</p>"
    rows = [(1, "http://h/a?x=1", page("first")), (2, "http://h/a?x=2", page("first").replace("menu", "other menu")), (3, "http://h/b", page("second")), (4, "http://h/b", page("second")), (5, "http://h/bb", ""), (6, "http://i/a", page("alone")), (7, "http://i/a", page("alone"))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.page_id: r.text for r in html.extract(d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {1: "first", 2: "first", 3: "second", 4: "second", 5: "", 6: "every page\nalone", 7: "every page\nalone"}


def test_attributes_are_not_found_in_values():
    own = """<article><div style="overflow:hidden">one</div><p title="the hidden cost">two</p><p data-id="ad" data-class='nav'>three</p><p title='class="ad"'>four</p></article>"""
    assert html.main_text(html.lines_of(own), None) == "one\ntwo\nthree\nfour"
    assert html.main_text(html.lines_of("<article><p hidden>a</p><p HIDDEN=''>b</p><p aria-hidden=true>c</p><p id = ad>d</p><p lang=en class='nav'>e</p>f</article>"), None) == "f"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    def length(x, y):
        return 0 if not x or not y else 1 + length(x[1:], y[1:]) if x[0] == y[0] else max(length(x[1:], y), length(x, y[1:]))

    keep = [a[i] for i in sorted(html.shared(a, b))]
    it = iter(b)
    assert len(keep) == length(a, b) and all(x in it for x in keep)


def test_shared_lines_of_long_pages():
    rng = random.Random(1)
    a = [f"line {rng.randrange(10**9)}" for _ in range(100_000)]
    b = [x for i, x in enumerate(a) if i % 3] + ["other"] * 50
    assert sorted(html.shared(a, b)) == [i for i in range(len(a)) if i % 3]
    assert len(html.shared(["x"] * 100_000, ["x", "y"] * 300)) == 300


def test_main_text_does_not_depend_on_partitions(spark):
    rows = [(2**60 + i, f"http://h{i % 3}/d{i % 5}/{i}", f"<nav>menu</nav><p>top of h{i % 3}</p><p>own {i}</p><p>under d{i % 5}</p>" + ("<article><p>art</p></article>" if i % 4 == 0 else "")) for i in range(60)]
    rows += [(None, "http://h0/d0/0", "<p>top of h0</p><p>no id</p>"), (None, None, None), (7, "x", "<p>alone</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 6, 211):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            seen.append(sorted((str(r.page_id), str(r.url), r.text) for r in html.extract(d.repartition(n)).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)
    got = {i: t for i, _, t in seen[0]}
    assert got[str(2**60)] == "art" and got[str(2**60 + 1)] in ("own 1", "own 1\nunder d1") and got["7"] == "alone"
    # by brute force: the neighbour in order of (path, id) whose path shares the longer prefix
    bare = sorted(((u.split("/", 3)[2], "/" + u.split("/", 3)[3], i, h) for i, u, h in rows if u and "://" in u), key=lambda r: (*r[:2], r[2] is not None, r[2] or 0))
    for k, (host, path, i, h) in enumerate(bare):
        page = html.lines_of(h)
        if i is None or any(x[1] for x in page):
            continue
        ends = [bare[j] for j in (k - 1, k + 1) if 0 <= j < len(bare) and bare[j][0] == host and bare[j][3] != h]
        prefix = lambda x: len(re.match(r"[^|]*", "".join(c if c == e else "|" for c, e in zip(x[1], path)))[0])  # noqa: B023, E731
        near = max(ends, key=lambda x: (prefix(x), -ends.index(x)))
        if near[2] is not None and all(e[2] is not None for e in ends):
            assert got[str(i)] == html.main_text(page, html.outside(html.lines_of(near[3])))


def test_pages_of_articles_keep_every_paragraph(spark):
    want = {}
    for r in documents(spark, "pages").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", body)
        import html as h

        want[r.page_id] = "\n".join(x for x in (" ".join(h.unescape(re.sub(r"<[^>]*>", " " if "br" in p else "", p)).split()) for p in parts) if x)
    assert {r.page_id: r.text for r in html.extract(documents(spark, "pages")).collect()} == want


def exact_neighbours(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    return {q: sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:k] for q, x in good if q % 100 == 0}


def test_ann_recall_and_scores(spark):
    d = documents(spark, "embeddings")
    want = exact_neighbours([(r.vec_id, r.embedding) for r in d.collect()])
    got = {}
    for r in sorted(queries.op7_ann(spark, SF).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q, v in exact_neighbours([(r.vec_id, r.embedding) for r in d.collect()], 10**6).items() for s, i in v}
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q, v in got.items() for s, i in v)


def test_ann_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (7, [0.0, 1.0]), (100, [1.0, 0.1]), (None, [1.0, 1.0]), (8, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.search(d, d.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [100, 6, 7], 100: [0, 6, 7]}
    assert ann.search(d.limit(0), d).count() == 0 and ann.search(d, d.limit(0)).count() == 0


def test_ann_of_repeated_queries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = sorted(map(tuple, ann.search(d, d.where("vec_id % 100 = 0")).collect()))
    twice = d.where("vec_id % 100 = 0")
    assert sorted(map(tuple, ann.search(d, twice.union(twice)).collect())) == once and len(once) == 30
    more = spark.createDataFrame([(0, rng.normal(size=8).tolist())], d.schema)
    got = {r.vec_id: r.score for r in ann.search(d, d.where("vec_id = 0").union(more)).collect()}
    v = {i: np.array(x) for i, x in rows}
    sides = [v[0], np.array(more.first().embedding)]
    want = sorted((min(float(np.sqrt(((x - s) ** 2).sum())) for s in sides), i) for i, x in v.items() if i)[:10]
    assert sorted(got) == sorted(i for _, i in want) and all(got[i] == pytest.approx(s) for s, i in want)


def test_ann_recall_over_several_chunks(spark):
    """20,000 evenly spread rows, the hardest case, in chunks of 4,096."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    pivots, chunk, found = x[rng.choice(len(x), ann.PIVOTS, replace=False)], 4096, {}
    queries = np.arange(0, len(x), 100)
    for a in range(0, len(x), chunk):
        ids = np.arange(a, min(a + chunk, len(x)))
        files = np.ascontiguousarray(ann.places(x[ids], pivots).T)
        for q, r, s in zip(*ann.search_chunk(files, ids, x[ids], queries, x[queries], pivots, 10), strict=True):
            found.setdefault(q, []).append((s, ids[r]))
    hits = 0
    for k, q in enumerate(queries):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({i for _, i in sorted(found[k])[:10]} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(queries)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    k = langid.HIDDEN
    m = langid.Model(["a", "b"], [rng.normal(0, 0.5, (3 * k, 256)) for _ in "ab"], [rng.normal(0, 0.5, (3 * k, k)) for _ in "ab"], rng.normal(0, 0.5, (2, 2 * k)), rng.normal(0, 0.5, (2, 1)))
    text, y = rng.integers(97, 100, (6, 3)).astype(np.uint8), np.array([0, 1, 0])

    def loss():
        span, lanes = text.shape
        states = []
        for d, order in enumerate((range(span), range(span - 1, -1, -1))):
            h, held = np.zeros((k, lanes)), {}
            for t in order:
                held[t] = h = langid._step(m.x[d], m.u[d], text[t], h)[4]
            states.append(held)
        p = [langid._softmax(m.w @ np.concatenate((states[0][t], states[1][t])) + m.c) for t in range(span)]
        return -np.mean([np.log(q[y, np.arange(lanes)]) for q in p])

    for array, grad in zip([*m.x, *m.u, m.w, m.c], langid._gradients(m, text, y), strict=True):
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(6)] + ([(0, 98)] if array.shape[1] == 256 else []):
            old, e = array[at], 1e-5
            array[at] = old + e
            up = loss()
            array[at] = old - e
            down = loss()
            array[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


def test_language_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert out and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in got)


def test_language_does_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    text = lambda a: bytes(rng.choice(list(a), 700).astype(np.uint8)).decode()
    m = langid.train([text(b"abc ").encode() for _ in range(20)] + [text(b"xyz ").encode() for _ in range(20)], ["a"] * 20 + ["x"] * 20, steps=30)
    texts = [text(b"abc "), "x", text(b"xyz ")[:300], None, "", "zy" * 5000]
    p = langid.probabilities(m, *buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert p[i] == pytest.approx(langid.probabilities(m, *buffers(pa.array([t], pa.string())))[0], abs=1e-4)
    assert p[0].argmax() == 0 and p[5].argmax() == 1 and p[5].sum() == pytest.approx(1, abs=1e-3)


def test_numbers_are_no_letters(spark):
    rows = [(i, t) for i, t in enumerate(["\u00bd", "\u00b2", "\u2163", "\u2460", "12 ?!", "a", "\u00e9", "\u6f22"])]
    d = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    model = langid.fit(documents(spark).select("doc_id", "text", "lang"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(d, model).collect()}
    assert [got[i] == "und" for i, _ in rows] == [True] * 5 + [False] * 3


def test_language_of_awkward_rows(spark):
    rows = langid.identify(awkward(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (2, 3, 6, 7)) and by[4].lang_pred in ("en", "de", "fr") and not by[None].held_out
    assert langid.identify(awkward(spark).limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_known(awkward(spark))
    assert kept.columns == awkward(spark).columns and {r.doc_id for r in kept.collect()} == {1, 4, None, 5, 8}


def test_image_copies(spark):
    import struct

    a = [media.drawn(i) for i in range(12)]
    rows = [(10 * i, media.pgm(x)) for i, x in enumerate(a)] + [(10 * i + k + 1, media.pgm(media.edited(a[i], k))) for i in range(4) for k in range(3)]
    rows += [(500, None), (501, b""), (502, b"P5\nbroken"), (503, media.pgm(np.full((96, 96), 7))), (None, media.pgm(a[0])), (504, media.pgm(a[5])), (505, media.pgm(a[0][:8]))]
    h, w = (n for n in (96, 96))
    raw = zlib.compress(b"".join(b"\0" + np.clip(np.rint(a[6][r]), 0, 255).astype(np.uint8).tobytes() for r in range(h)))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    rows.append((506, b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", raw) + chunk(b"IEND", b"")))
    d = spark.createDataFrame(rows, "image_id long, image binary").withColumn("id", F.lit("clash"))
    got = {r.image_id: r.group_id for r in media.copies(d).collect()}
    found = sum(got[10 * i + k + 1] == 10 * i for i in range(4) for k in range(3))
    assert found >= 11 and got[504] == 50 and got[506] == 60
    assert all(got[i] == i for i in (500, 501, 502, 503, 505)) and got[None] is None and len({got[10 * i] for i in range(12)}) == 12
    assert media.copies(d.limit(0)).count() == 0


def test_image_copies_among_images_with_common_corners(spark):
    # 40 other images hold the halves of a picture; as many cells have them as pivots
    a, rng = media.drawn(900, 128), np.random.default_rng(0)
    rows = [(1, a), (2, a * 0.9 + 12)]
    for k in range(40):
        other, cut = media.drawn(1000 + k, 128), (slice(0, 64), slice(64, 128))[k % 2]
        quarter = (slice(0, 64), slice(64, 128))[k // 2 % 2]
        other[cut, quarter] = a[cut, quarter]
        rows.append((10 + k, other + rng.normal(0, 0.1, a.shape)))
    d = spark.createDataFrame([(i, media.pgm(x)) for i, x in rows], "image_id long, image binary")
    found = media.descriptors(d).cache()
    pivots = {(r._a, r._b) for r in media.matches(found, media.pivot_pairs(media.cells(found))).withColumnsRenamed({"a": "_a", "b": "_b"}).collect()}
    rest = all_pairs_with_votes(spark, found)
    assert rest - pivots and (2, 1) in rest
    got = {r.image_id: r.group_id for r in media.copies(d).collect()}
    assert got[1] == got[2]


def all_pairs_with_votes(spark, found):
    """The image pairs with VOTES matched corners by brute force over cells; asserts that the search finds all."""
    met = media.cells(found)
    near = {(r.a, r.b) for r in media.unconnected_pairs(found, met, spark.createDataFrame([], "id long, component long")).collect()}
    by, votes, word = {}, {}, {r.id: np.frombuffer(r.words, np.uint64) for r in found.collect()}
    for r in met.collect():
        by.setdefault(r.block, []).append(r.id)
    for x, y in {(x, y) for ids in by.values() for x in ids for y in ids if x >> 8 > y >> 8}:
        if np.bitwise_count(word[x] ^ word[y]).sum() <= media.BITS:
            f, g = votes.setdefault((x >> 8, y >> 8), (set(), set()))
            f.add(x)
            g.add(y)
    enough = {k for k, v in votes.items() if min(map(len, v)) >= media.VOTES}
    assert enough <= near
    full = {(r._a, r._b) for r in media.compared(found, spark.createDataFrame(sorted(near), "a long, b long")).collect()}
    assert enough == full
    return enough


def test_large_cells_are_searched_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(media, "CHUNK", 4)
    d = spark.createDataFrame([(i, media.pgm(media.drawn(5) * (0.9 if i % 2 else 1) + i % 7)) for i in range(15)], "image_id long, image binary")
    assert len(all_pairs_with_votes(spark, media.descriptors(d).cache())) == 105


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "mixture", "sequences"]
    extra = [(100 + i, None, None, None, None) for i in range(2)]
    d = awkward(spark, extra).select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == corpus_pipeline.COLUMNS
        d = spark.createDataFrame(d.collect(), DOCS)
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count()
    rows = corpus_pipeline.run(spark, SF).collect()
    exact_sequences(rows)
    assert len({r.doc_id for r in rows}) > 100
    # each document's pieces of one use hold its tokens once
    for parts in exact_sequences(rows).values():
        assert sum(n for _, n in parts) > 0


def test_near_copy_stage_keeps_one_of_each_group(spark):
    d = documents(spark)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, d, SF).collect()}
    assert kept == {d_ for d_, _, c in brute_components([(r.doc_id, r.text) for r in d.collect()], 5, 4, 5) if d_ == c}


def test_parities_of_several_sizes_bound_the_difference():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, int(n)).astype(np.uint64)) for n in (1, 3, 40, 500, 513, 700, 2500, 2600, 9000)]
    sets += [np.unique(np.concatenate((s[len(s) // 20 :], rng.integers(0, 1 << 62, len(s) // 20).astype(np.uint64)))) for s in sets]
    n = np.array([len(s) for s in sets])
    held = setjoin.sketches(np.concatenate(sets), n, least=ngramjoin.CELLS)
    assert min(map(len, held)) == ngramjoin.CELLS // 8 and max(map(len, held)) > 1000
    p = ngramjoin.Parities(held)
    r, s = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = p.differing(r, s)
    for i, j, d in zip(r.tolist(), s.tolist(), got.tolist(), strict=True):
        assert d == setjoin.differing(held[i], held[j]) <= len(np.setxor1d(sets[i], sets[j]))
        far = 9 * len(np.setxor1d(sets[i], sets[j])) > 3 * (n[i] + n[j])
        fit = max(n[i], n[j]) <= 1.25 * min(n[i], n[j])
        assert not (far and fit) or min(n[i], n[j]) < 100 or 9 * d > n[i] + n[j]  # large sets that are far apart do not pass
