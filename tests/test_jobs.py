"""The jobs over growing input, run again, after a lost commit, and from the command line."""

import hashlib
import json
import os
import shutil
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import policy_replay, registered, text_ledger

SF = "/root/testdata/sf0.001"
CONFIG = {
    "files_per_batch": 1000,
    "relations": [
        {"name": "documents", "schema": "doc_id long, text string, source string", "key": ["doc_id"], "text": "text", "group": "source"},
        {"name": "conversations", "schema": "conv_id long, turn long, role string, text string", "key": ["conv_id", "turn"], "text": "text", "group": "role"},
    ],
}
DELIVERIES = [
    {"documents": [(1, "a\nb", "s"), (2, "same", "s"), (2, "same", "r"), (3, None, "s"), (None, "a\nb", None), (4, "x", "s"), (4, "y", "s")], "conversations": [(1, 0, "user", "same"), (1, None, "user", "lost"), (1, 1, None, "")]},
    {"documents": [(1, "a\nb", "s"), (2, "other", "s"), (3, "now", "s"), (5, "same", None)], "conversations": [(2, 0, "user", "new here")]},
    {"documents": [(2, "same", "s"), (4, "y", "s"), (3, None, "s"), (6, "new here", "s")]},
]


def deliver(spark, folder, n):
    schemas = {"documents": "doc_id long, text string, source string", "conversations": "conv_id long, turn long, role string, text string"}
    for name, rows in DELIVERIES[n].items():
        spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def expected(n):
    """The ledger after the first n deliveries, by definition."""
    out, latest, first = [], {}, {}
    for batch, tables in enumerate(DELIVERIES[:n]):
        held = defaultdict(list)
        for name, rows in tables.items():
            for r in rows:
                key, text, grp = (None if r[0] is None else str(r[0]), r[1], r[2]) if name == "documents" else (None if None in r[:2] else f"{r[0]}:{r[1]}", r[3], r[2])
                held[name, key, None if text is None else hashlib.sha256(text.encode()).hexdigest()].append((grp, text))
        texts = defaultdict(set)
        for name, key, sha in held:
            texts[name, key].add(sha)
            if key is not None and sha is not None and (sha not in first or first[sha][0] == batch):
                first[sha] = min(first.get(sha, (batch, "~")), (batch, f"{name}/{key}"))
        for (name, key, sha), rows in held.items():
            last = latest.get((name, key), "none")
            status = "unkeyed" if key is None else "conflict" if len(texts[name, key]) > 1 else "new" if last == "none" else "known" if last == sha else "changed"
            text = rows[0][1]
            at, holder = first.get(sha, (None, None))
            out.append((key, min((g for g, _ in rows if g is not None), default=None), len(rows), None if text is None else len(text), None if text is None else text.count("\n") + 1, sha, holder, at, status, name, batch))
        latest |= {k: max(v, key=lambda s: s or "") for k, v in texts.items()}
    return sorted(out, key=str)


def ledger(spark, folder):
    return sorted(map(tuple, text_ledger.read_ledger(spark, f"{folder}/out").collect()), key=str)


def take(spark, folder):
    return text_ledger.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", CONFIG)


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/in/conversations.parquet")
    for n in range(3):
        deliver(spark, f"{tmp_path}/in", n)
        done = take(spark, tmp_path)
        rows = sum(map(len, DELIVERIES[n].values()))
        assert (done["batches"], done["rows_read"]) == (1, rows)
        assert ledger(spark, tmp_path) == expected(n + 1)
        assert take(spark, tmp_path)["batches"] == 0 and ledger(spark, tmp_path) == expected(n + 1)
    statuses = {r[8] for r in ledger(spark, tmp_path)}
    assert statuses == set(text_ledger.STATUSES)


def test_ledger_is_the_same_after_a_lost_commit(spark, tmp_path):
    for n in range(2):
        deliver(spark, f"{tmp_path}/in", n)
        take(spark, tmp_path)
    commits = Path(f"{tmp_path}/checkpoint/commits")
    for f in (commits / "1", commits / ".1.crc"):  # as if the session had died after the output and before the commit
        f.unlink(missing_ok=True)
    deliver(spark, f"{tmp_path}/in", 2)
    assert take(spark, tmp_path)["batches"] == 2
    assert ledger(spark, tmp_path) == expected(3)


def test_ledger_with_a_file_a_batch_equals_deliveries_in_order(spark, tmp_path):
    for n in range(3):
        deliver(spark, f"{tmp_path}/in", n)
    few = CONFIG | {"files_per_batch": 1}
    done = text_ledger.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", few)
    assert done["batches"] == 3 and ledger(spark, tmp_path) == expected(3)


def test_ledger_from_the_command_line(tmp_path):
    shutil.copytree(SF, tmp_path / "in", copy_function=shutil.copy)
    root = Path(__file__).resolve().parents[1]
    env = os.environ | {"PYTHONPATH": str(root), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    args = [sys.executable, "-m", "jobs.text_ledger", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "checkpoint")]
    said = subprocess.run(args, cwd=root, env=env, capture_output=True, text=True, timeout=300, check=True).stderr
    assert "reading new files of" in said and "batch 0: {'batches': 1, 'rows_read':" in said and (tmp_path / "out/relation=pages").is_dir()


def replayed(spark, folder):
    return sorted(map(tuple, spark.read.schema(policy_replay.OUTPUT).parquet(folder).collect()), key=str)


def test_replay_of_some_scenes_overwrites_those_alone(spark, tmp_path):
    config = json.loads(policy_replay.CONFIG.read_text()) | {"frames_per_scene": 10, "policies": ["LEGACY", "GROUND_LIMITED"]}
    out = f"{tmp_path}/out"
    done = policy_replay.run(spark, SF, out, config)
    whole = replayed(spark, out)
    assert done["rows"] == len(whole) and done["LEGACY"] == sum(r[11] for r in whole if r[12] == "LEGACY") and len({r[13] for r in whole}) > 1
    assert policy_replay.run(spark, SF, out, config) == done and replayed(spark, out) == whole
    # scene 0 alone, under other rules, and back
    strict = config | {"min_points": 10**6, "first_scene": 0, "last_scene": 0}
    assert policy_replay.run(spark, SF, out, strict)["LEGACY"] == 0
    mixed = replayed(spark, out)
    assert [r for r in mixed if r[13] != 0] == [r for r in whole if r[13] != 0] and not any(r[11] for r in mixed if r[13] == 0)
    policy_replay.run(spark, SF, out, config | {"first_scene": 0, "last_scene": 0})
    assert replayed(spark, out) == whole


def test_replay_counts_add_up_and_equal_policies_agree(spark, tmp_path):
    config = json.loads(policy_replay.CONFIG.read_text())
    policy_replay.run(spark, SF, f"{tmp_path}/out", config)
    d = spark.read.schema(policy_replay.OUTPUT).parquet(f"{tmp_path}/out")
    assert not d.where("n_owned <> n_temporal + n_occupancy + n_kept or measured <> (n_kept >= 3) or measured <> (cx is not null)").count()
    same = [sorted(map(tuple, d.where(F.col("policy") == p).drop("policy").collect()), key=str) for p in ("GROUND_LIMITED", "HEIGHT_BANDED")]
    assert same[0] == same[1] and same[0]
    with pytest.raises(ValueError):
        policy_replay.run(spark, SF, f"{tmp_path}/none", config | {"policies": ["NO_SUCH"]})


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_jobs_as_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    got = registered.QUERIES[name](spark, SF).toArrow()
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))
    c.register("got", got)
    c.sql(f"CREATE TABLE want AS {registered.ORACLES[name]}")
    k = ", ".join(c.sql("SELECT * FROM want").columns)
    assert got.num_rows and not c.sql(f"(SELECT {k} FROM want EXCEPT ALL SELECT {k} FROM got) UNION ALL (SELECT {k} FROM got EXCEPT ALL SELECT {k} FROM want)").fetchall()
