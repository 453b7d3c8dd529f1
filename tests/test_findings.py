"""Findings of a review, each on a small input that failed before."""

from bisect import bisect_left, bisect_right
from math import atan2, degrees, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fusegrid.functions import geometry as G
from fusegrid.llm import html, linededup, media
from fusegrid.operators import aggregates as A
from fusegrid.operators import cluster, joins, windows
from fusegrid.plans import queries_analysis, queries_geometry, queries_online
from fusegrid.streaming import online


SF = "/root/testdata/sf0.001"


def test_nearest_timestamp_within_reach_and_ties(spark):
    """by running minima; nothing farther than the reach is taken, however near its bucket, and the earlier of two equally near ones."""
    left = [(i, (i * 7919) % 5000 * 13) for i in range(400)] + [(400, 300_000), (401, 500_000), (402, None)]
    right = [(i, (i * 104_729) % 6000 * 11) for i in range(300)] + [(300, 299_990), (301, 300_010), (302, 300_010), (303, 505_100), (304, None)]
    got = joins.nearest_timestamp(spark.createDataFrame(left, "idx long, ts long"), spark.createDataFrame(right, "r long, rts long"), "ts", "rts", 5000)
    times = sorted(t for _, t in right if t is not None)
    want = {}
    for i, t in left:
        if t is None:
            continue
        near = [times[bisect_right(times, t) - 1]] if bisect_right(times, t) else []
        near += [times[bisect_left(times, t)]] if bisect_left(times, t) < len(times) else []
        best = min(near, key=lambda x: (abs(t - x), x))
        if abs(t - best) <= 5000:
            want[i] = (min(r for r, x in right if x == best), best)
    assert {x.idx: (x.r, x.rts) for x in got.collect()} == want
    assert want[400] == (300, 299_990) and 401 not in want and len(want) > 390


def test_nearest_timestamp_by_key_makes_no_pairs(spark):
    """keys stay apart, and rows of one moment meet without a join of one with another."""
    left = spark.createDataFrame([("a", 1, 100), ("b", 2, 100), (None, 3, 100)], "k string, idx long, ts long")
    right = spark.createDataFrame([("a", 7, 90), ("b", 8, 130), (None, 9, 101)], "k string, r long, rts long")
    got = joins.nearest_timestamp(left, right, "ts", "rts", 1000, ["k"])
    assert sorted((x.k or "", x.idx, x.r) for x in got.collect()) == [("", 3, 9), ("a", 1, 7), ("b", 2, 8)]
    crowd = spark.range(50_000).selectExpr("id AS idx", "id % 10 AS ts")
    got = joins.nearest_timestamp(crowd, crowd.selectExpr("idx AS r", "ts AS rts"), "ts", "rts", 1_000_000)
    assert got.count() == 50_000 and got.where("r <> idx % 10").count() == 0


def test_angles_of_one_direction_are_equal(spark):
    """two points in one direction tie, so their numbers decide the order of a ring."""
    rows = [(8.51, -3.2199999999999998, -1.7100000000000002), (8.879999999999999, -3.36, -1.74)] + [(1 + i * 37 % 900 / 100, i * 53 % 800 / 100 - 4, i * 13 % 240 / 100 - 2.2) for i in range(3000)]
    d = spark.createDataFrame(rows, "x double, y double, z double")
    _, azimuth, elevation = G.spherical("x", "y", "z")
    got = d.select("x", "y", "z", azimuth.alias("a"), elevation.alias("e")).collect()
    assert got[0].a == got[1].a
    assert all(r.a == degrees(atan2(r.y, r.x)) and r.e == degrees(atan2(r.z, sqrt(r.x * r.x + r.y * r.y))) for r in got)
    ring = spark.createDataFrame([(1, 91, *rows[0]), (1, 128, *rows[1]), (1, 5, 8.969999999999999, -3.4, -1.9900000000000002), (1, 6, 9.5, -3.4699999999999998, -1.9)], "frame long, pid long, x double, y double, z double")
    # 5 and 91 differ in range by more than .25, 128 does not lie between them
    assert {5, 91} <= {r.pid for r in windows.ring_edges(ring).collect()}


def test_distances_are_plain_roots(spark):
    """equal distances tie, so the smaller edge comes first."""
    d = spark.range(2000).selectExpr("id DIV 100 AS frame", "id AS pid", "id * 379 % 12800 / 10 AS u", "id * 631 % 7200 / 10 AS v")
    edges = d.where("pid % 7 = 0").selectExpr("frame", "pid AS edge", "u", "v")
    at = {r.pid: (r.frame, r.u, r.v) for r in d.collect()}
    held = [(r.edge, r.frame, r.u, r.v) for r in edges.collect()]
    got = {}
    for r in joins.nearest_of(d, edges, ["frame"], "pid", "edge", 2, 16.0).collect():
        got.setdefault(r.pid, []).append((r["rank"], r.distance, r.edge))
    for pid, (frame, u, v) in at.items():
        want = sorted((sqrt((u - x) ** 2 + (v - y) ** 2), e) for e, f, x, y in held if f == frame)[:2]
        assert [(d, e) for _, d, e in sorted(got[pid])] == want


def _slow_labels(xyz):
    label, r = list(range(len(xyz))), [0.18 + 0.02 * sqrt(x * x + y * y) for x, y, _ in xyz]
    for _ in xyz:
        for i in range(len(xyz)):
            for j in range(i + 1, len(xyz)):
                if sqrt(sum((a - b) ** 2 for a, b in zip(xyz[i], xyz[j], strict=True))) <= r[i]:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_components_of_many_groups_at_once(spark):
    """All groups of a batch are labelled together, not one call of Python a group, also across batches and for null keys."""
    rng = np.random.default_rng(3)
    rows = [(None if f == 5 else f, f"k{d}", 1000 - p, *map(float, rng.random(3) * (1.2, 1.2, 0.8))) for f in range(12) for d in range(3) for p in range((f * 7 + d * 5) % 23)]
    d = spark.createDataFrame(rows, "frame long, det string, pid long, x double, y double, z double").repartition(3)
    want = {}
    for key in {r[:2] for r in rows}:
        g = sorted(r[2:] for r in rows if r[:2] == key)
        want |= {(*key, r[0]): g[label][0] for r, label in zip(g, _slow_labels([r[1:] for r in g]), strict=True)}
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            out = cluster.label_components(d)
            plan = out._jdf.queryExecution().toString()
            assert "FlatMapGroups" not in plan
            assert {(r.frame, r.det, r.pid): r.label for r in out.collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = rng.random((400, 3))
    assert (cluster.group_labels(np.array([0, 150, 151]), many, 64) == np.concatenate([_slow_labels(many[a:b].tolist()) + np.int64(a) for a, b in ((0, 150), (150, 151), (151, 400))])).all()


def test_fold_keeps_its_partitions(spark):
    """Spark's merging of small partitions must not put the folds of all scenes into one or two tasks."""
    rows = spark.range(600).selectExpr("id DIV 3 AS scene", "(id % 3 + 1) * 100000000 AS ns", "CAST(1 AS INT) AS kind", "CAST(0 AS INT) AS det", "'PERSON' AS cls", "0.9D AS conf", "1D AS x1", "1D AS y1", "9D AS x2", "9D AS y2", "id / 1000D AS x", "1D AS y", "1D AS z")
    out = online.batch(queries_online.sightings(rows))
    assert out.where("det >= 0").count() == 600
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.rdd.getNumPartitions() == parts


def test_owners_of_variants_are_found_once(spark, monkeypatch, tmp_path):
    """no window over owners for each policy."""
    seen = []
    whole = joins.owners
    monkeypatch.setattr(joins, "owners", lambda points, boxes, keys=("frame",), point="pid": seen.append(tuple(keys)) or whole(points, boxes, keys, point))
    rows = queries_online.variant_rows(spark, "/root/testdata/sf0.001")
    assert set(seen) == {("frame",)}
    n = {r.variant: r["count"] for r in rows.groupBy("variant").count().collect()}
    assert len(n) == 12 and len(set(n.values())) == 1


def test_model_residuals_gather_no_values(spark):
    """quantiles of two large groups by selection; percentile kept every value of a group in one task."""
    out = queries_analysis.QUERIES["model_residuals"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median(" not in plan
    assert {r.n for r in out.where("split = 'fit'").collect()} and out.count() == 18


def _nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_place_counts_once_and_points_stay_in_place(spark):
    """A place that many suppliers share is posted once, and flags are columns of the point, not joins of numbered points."""
    places = spark.range(20_000).selectExpr("id % 40 / 10 AS ox", "id % 20 / 10 AS oy")
    points = spark.range(500).selectExpr("id AS pid", "id % 45 / 10 + 0.03 AS x", "id % 25 / 10 + 0.03 AS y").union(spark.sql("SELECT -1L, CAST(NULL AS DOUBLE), 1.0D"))
    flagged = joins.near_flag(points, places, 0.07)
    here = {(i % 40 / 10, i % 20 / 10) for i in range(40)}
    assert {r.pid: r.near for r in flagged.collect()} == {-1: False} | {i: any(sqrt((i % 45 / 10 + 0.03 - a) ** 2 + (i % 25 / 10 + 0.03 - b) ** 2) <= 0.07 for a, b in here) for i in range(500)}
    assert sorted(r.pid for r in joins.near_any(points, places, 0.07).collect()) == sorted(r.pid for r in flagged.where("near").collect())
    assert _nodes(flagged).count("ExistenceJoin") == 1 and "Aggregate [" in _nodes(flagged)
    owned = {(r.frame, r.pid) for r in queries_geometry._owned(spark, SF).collect()}
    assert {(r.frame, r.pid) for r in queries_geometry._flagged(spark, SF).where("person_owned").collect()} == owned
    for df in (queries_analysis.box_stage_trace(spark, SF), queries_geometry._near_and_prior(spark, SF, queries_geometry._gated(spark, SF))):
        assert "row_number" not in _nodes(df).replace("row_number() windowspecdefinition(frame", "", 1) and _nodes(df).count("row_number() windowspecdefinition(frame") == 1


def test_components_leave_their_task_as_one_row(spark):
    """one pass gives what labels and percentiles give, to the last bit."""
    rng = np.random.default_rng(5)
    rows = [(int(f), d, i, *map(float, p)) for f in range(6) for d in range(3) for i, p in enumerate(rng.uniform(0, 1, (int(rng.integers(1, 90)), 3)).round(2))]
    rows.append((6, 0, 0, None, 1.0, 1.0))
    d = spark.createDataFrame(rows, "frame long, det int, pid long, x double, y double, z double")
    want = cluster.components(cluster.label_components(d))
    got = cluster.found_components(d)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    assert not _nodes(got).count("percentile")


def test_pairs_far_apart_in_x_are_not_compared():
    """points along ten metres are compared with those within the radius in x, and labelled as by all pairs."""
    rng = np.random.default_rng(3)
    xyz = np.column_stack([rng.uniform(0, 10, 4000).round(2), np.zeros(4000), rng.uniform(0, 4, 4000).round(2)])
    start, r = np.array([0, 1500, 1501]), 0.18 + 0.02 * xyz[:, 0]
    order, later = cluster._ahead(start, xyz[:, 0], r)
    assert later.sum() < 0.1 * sum(k * (k - 1) / 2 for k in (1500, 1, 2499))
    place = np.argsort(order)
    for i in range(0, 4000, 97):
        low, high = [(a, b) for a, b in ((0, 1500), (1500, 1501), (1501, 4000)) if a <= i < b][0]
        for j in range(low, high):
            if j != i and np.sqrt(((xyz[i] - xyz[j]) ** 2).sum()) <= r[min(i, j)]:
                a, b = sorted((place[i], place[j]))
                assert b - a <= later[a]
    few = xyz[:120]
    assert (cluster.group_labels(np.array([0]), few) == _slow_labels(few.tolist())).all()
    few[7, 0] = np.nan
    assert (cluster.group_labels(np.array([0]), few) == _slow_labels(few.tolist())).all()


def test_policies_are_measured_without_copies_of_points(spark):
    """a box's points are there once for all policies; a policy that keeps none has a row without a centre."""
    rows = [(0, 0, d, i, float(i % 7), float(i % 5), 1.0 + i % 3, i % 4 != 0, d == 0) for d in range(3) for i in range(40)]
    d = spark.createDataFrame(rows, "scene long, frame long, det int, pid long, x double, y double, z double, a boolean, b boolean")
    got = {(r.det, r.keep): r for r in cluster.kept_measurements(d, ["a", "b"], ["scene", "frame", "det"], "pid").collect()}
    assert len(got) == 6 and got[1, "b"].n == 0 and got[1, "b"].cx is None and got[0, "b"].n == 40 and got[2, "a"].n == 30
    for keep in "ab":
        for r in d.where(keep).groupBy("det").agg(F.count("pid").alias("n"), *[A.robust_center(c).alias(f"c{c}") for c in "xyz"], A.span("z").alias("vspan")).collect():
            assert tuple(r)[1:] == tuple(got[r.det, keep][c] for c in ("n", "cx", "cy", "cz", "vspan"))


def test_neighbours_are_posted_near_borders_only(spark):
    """the same neighbours as all pairs, also at the radius itself, from under half as many posted rows as nine a point."""
    d = spark.range(900).selectExpr("id % 3 AS frame", "id AS pid", "CAST(id % 60 * 5 AS double) AS u", "CAST(id DIV 60 * 14 AS double) AS v")
    rows, want = d.collect(), {}
    for a in rows:
        near = sorted((sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2), b.pid) for b in rows if b.frame == a.frame and b.pid != a.pid)
        want[a.pid] = [x for x in near if x[0] <= 14.0][:9]
    got = {a.pid: [] for a in rows}
    for r in sorted(joins.nearest_k(d, ["frame"], "pid", 9, 14.0).collect(), key=lambda r: r["rank"]):
        got[r.pid].append((r.distance, r.neighbour))
    assert got == want and any(x[0] == 14.0 for v in want.values() for x in v)
    assert joins.posted_cells(d.select("u", "v"), 14.0, "u", "v").count() < 900 * 4


def test_few_edges_are_settled_in_one_round(spark, monkeypatch):
    from fusegrid.plans import components

    written = []
    monkeypatch.setattr(components, "materialize", lambda df, tag, f=components.materialize: written.append(f(df, tag)) or written[-1])
    path = spark.range(0, 3000, 1, 8).selectExpr("id as a", "id + 1 as b").union(spark.range(1).selectExpr("id as a", "7L as b"))
    got = components.connected_components(path.repartition(8))
    assert got.agg(F.min("component"), F.max("component"), F.count("id"), F.count_distinct("id")).first() == (0, 0, 3001, 3001)
    assert len(written) <= 2
    assert spark.read.parquet(written[-1].scratch_path).rdd.getNumPartitions() == 1


def test_components_beyond_the_broadcast_and_of_other_ids(spark, monkeypatch):
    from fusegrid.plans import components

    monkeypatch.setattr(components, "BROADCAST_EDGES", 10)
    monkeypatch.setattr(components, "PER_FILE", 16)
    monkeypatch.setattr(components, "FOREST", 8)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    by_number = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    named = spark.createDataFrame([(f"{a:05}", f"{b:05}") for a, b in edges], "a string, b string")
    by_name = components.connected_components(named)
    assert sorted(map(tuple, by_number.collect())) == sorted((int(i), int(c)) for i, c in by_name.collect())


def test_filters_are_as_large_as_their_rows_need(spark):
    from fusegrid.llm.bitmaps import filter_of, held

    bits = filter_of(spark.range(5000).toDF("id"), 5000)
    assert len(bits) <= 5000 * 64 // 8
    assert held(bits, np.arange(5000)).all()
    assert held(bits, np.arange(5000, 105_000)).mean() < 0.05


def test_images_with_few_matched_corners_give_no_rows(spark, monkeypatch):
    """The search of op9 gives a pair of images once, and only if SHARED corners match alike in scale and turn."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(media, "CHUNK", 16)
    common = rng.integers(-(2**31), 2**31, (4, 8)).astype(np.int32)
    rows = []
    for i in range(60):
        # image i has the first i % 5 common corners; every third image's are turned each in its own way
        for k in range(8):
            w = common[k] if k < i % 5 else rng.integers(-(2**31), 2**31, 8).astype(np.int32)
            rows.append((256 * i + k, w.tobytes(), i, 1.0 * k, 2.0 * k, 1.0, float(k if i % 3 == 0 else 0)))
    found = spark.createDataFrame(rows, media.SCHEMA).cache()
    met = spark.createDataFrame([(k, 256 * i + k, 48) for i in range(60) for k in range(4) if k < i % 5], "block long, id long, m long")
    monkeypatch.setattr(media, "rare_cells", lambda met: met.withColumn("image_id", F.floor(F.col("id") / 256)))
    group = spark.createDataFrame([(i, 3 if i in (3, 8, 13) else i) for i in range(60)], "id long, component long")
    pairs = {(a, b) for a in range(60) for b in range(a) if min(a % 5, b % 5) >= 3 and not {a, b} <= {3, 8, 13}}
    for alike, want in ((False, pairs), (True, {(a, b) for a, b in pairs if (a % 3 == 0) == (b % 3 == 0)})):
        got = [tuple(r) for r in media.unconnected_pairs(found, met, group, alike=alike).collect()]
        assert sorted(got) == sorted(want)


def test_lines_are_named_only_where_they_are_posted_and_no_text_is_sorted(spark, monkeypatch):
    """op10: postings name as many lines as they hold, and the texts meet their places without a sort."""
    words = [f"w{i}" for i in range(40)]
    table = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([" ".join(words[i : i + 9]) for i in (0, 10, 20)])], ["doc_id", "text"])
    cell = np.arange(linededup.CELLS, dtype=np.uint64)
    asked = []
    own = linededup.fingerprints
    monkeypatch.setattr(linededup, "fingerprints", lambda tokens, n: asked.append(len(n)) or own(tokens, n))
    row, place, _, n, tokens = linededup.compared(table, 1, (cell, cell))
    linededup.Postings(linededup.THRESHOLD, 8, cell, np.zeros(1 << 13, np.uint8)).add(n, tokens, row, place)
    assert sum(asked) == 0
    posted = linededup.Postings(linededup.THRESHOLD, 8, cell)
    posted.add(n, tokens, row, place)
    assert asked[-1] == 3 and np.array_equal(posted.lines[0]["id"], linededup.compared(table, 1)[2])
    d = spark.createDataFrame([(1, "a b c\nd e f"), (2, "a b c")], "doc_id long, text string")
    plan = linededup.dedup(d)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_parts_of_images_are_stored_once_and_searched_without_a_shuffle(spark, monkeypatch):
    """op9: what is on disk does not grow with the pairs of parts, each pair is a task, and all links of the plain comparison are found."""
    a = [media.drawn(i) for i in range(14)]
    rows = [(10 * i, media.pgm(x)) for i, x in enumerate(a)] + [(10 * i + k + 1, media.pgm(media.edited(a[i], k))) for i in range(6) for k in range(3)]
    found = media.descriptors(spark.createDataFrame(rows, "image_id long, image binary")).cache()
    met, none = media.cells(found), spark.createDataFrame([], "id long, component long")
    links = lambda pairs: {(r.a, r.b, r.votes) for r in media.consensus(media.matches(found, pairs)).collect()}
    want = links(media.compared(found, media.unconnected_pairs(found, met, none, alike=True)))
    assert len(want) >= 15
    own, seen = media.materialize, []

    def kept(df, tag, **by):
        plan = df._jdf.queryExecution().executedPlan().toString()
        tasks = df.rdd.getNumPartitions()
        out = own(df, tag, **by)
        seen.append((tag, "Exchange" in plan, tasks, out.count(), out.select("part").distinct().count() if tag == "framed" else 0))
        return out

    monkeypatch.setattr(media, "CHUNK", 8)
    monkeypatch.setattr(media, "materialize", kept)
    rest = media.unconnected_matches(found, met, none)
    ((stored, parts),) = [x[3:] for x in seen if x[0] == "framed"]
    assert parts > 2 and stored == media.rare_cells(met).select("image_id").distinct().count()
    assert [x[1:3] for x in seen if x[0] == "candidates"] == [(False, parts * (parts + 1) // 2)]
    monkeypatch.setattr(media, "materialize", own)
    assert links(rest) == want


def test_pages_with_an_article_are_differenced_and_restored(spark):
    """op6: differencing runs on every page; what it would delete of an article is restored by the check, and counted."""
    article = lambda *lines: "<nav>menu</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"
    rows = [(1, "http://h/a/1", article("quote", "one", "end")), (2, "http://h/a/2", article("quote", "two", "end"))]
    rows += [(3, "http://g/1", "<p>slogan</p>" + article("quote", "art")), (4, "http://g/2", "<p>slogan</p><p>quote</p><p>loose</p>")]
    rows += [(5, "http://f/1", article("alone")), (6, "http://f/1", article("alone")), (7, "http://e/", None), (8, None, article("x", "x")), (9, None, article("x"))]
    want = {1: ("quote\none\nend", 2), 2: ("quote\ntwo\nend", 2), 3: ("quote\nart", 1), 4: ("quote\nloose", 0), 5: ("alone", 0), 6: ("alone", 0), 7: ("", 0), 8: ("x\nx", 1), 9: ("x", 1)}
    d, key = spark.createDataFrame(rows, "page_id long, url string, html string"), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    for threshold in (before, "-1"):
        spark.conf.set(key, threshold)
        try:
            got = {r.page_id: (r.text, r.n_restored) for r in html.extract(d).collect()}
        finally:
            spark.conf.set(key, before)
        assert got == want
