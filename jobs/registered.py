"""The jobs as queries: each runs twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusegrid.functions import model as M
from fusegrid.plans.queries_geometry import FLAGGED
from fusegrid.plans.registry import r6, registry
from fusegrid.plans.scratch import scratch_root
from jobs import policy_replay, text_ledger

QUERIES, ORACLES, query = registry()


def _folder(spark: SparkSession, job: str) -> str:
    return f"{scratch_root(spark)}/{job}-{uuid.uuid4().hex}"


@query("""WITH r AS (SELECT 'documents' AS relation, CAST(doc_id AS VARCHAR) AS key, source AS grp, text FROM documents
UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), NULL, html FROM pages
UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), role, text FROM conversations),
g AS (SELECT relation, key, sha256(text) AS sha256, min(grp) AS grp, count(*) AS copies, max(length(text)) AS n_chars, max(length(text) - length(replace(text, chr(10), '')) + 1) AS n_lines FROM r GROUP BY relation, key, sha256(text)),
f AS (SELECT sha256, min(relation || '/' || key) AS first_holder FROM g WHERE key IS NOT NULL AND sha256 IS NOT NULL GROUP BY sha256)
SELECT key, grp, copies, n_chars, n_lines, g.sha256, first_holder, CAST(CASE WHEN first_holder IS NOT NULL THEN 0 END AS BIGINT) AS first_batch,
  CASE WHEN key IS NULL THEN 'unkeyed' WHEN count(*) OVER (PARTITION BY relation, key) > 1 THEN 'conflict' ELSE 'new' END AS status, relation, CAST(0 AS BIGINT) AS batch FROM g LEFT JOIN f ON f.sha256 = g.sha256""")  # fmt: skip
def job1_text_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = _folder(spark, "job1"), json.loads(text_ledger.CONFIG.read_text())
    for _ in range(2):
        text_ledger.run(spark, sf_dir, f"{folder}/ledger", f"{folder}/checkpoint", config)
    return text_ledger.read_ledger(spark, f"{folder}/ledger")


_POLICIES = ", ".join(f"'{p}'" for p in M.POLICIES)


@query(f"""WITH {FLAGGED}, own AS (SELECT w.frame, w.det, w.x, w.y, w.z, w.h, f.near, NOT f.temporal_keep AS in_prior FROM owned w JOIN flagged f ON w.frame = f.frame AND w.pid = f.pid),
p AS (SELECT own.*, policy, near AND CASE policy WHEN 'LEGACY' THEN z - h <= 0.28e0 OR z - h >= 1.9e0 WHEN 'PHYSICAL_DIRECT' THEN h <= 0.28e0 OR h >= 1.9e0
  WHEN 'TEMPORAL_PRIMARY_OCCUPANCY_SECONDARY' THEN in_prior AND h >= 0 AND h <= 0.28e0
  WHEN 'PERSON_CONDITIONAL_PROTECTION' THEN (h <= 0.28e0 OR h >= 1.9e0) AND NOT (NOT in_prior AND h BETWEEN 0.08e0 AND 2.15e0)
  ELSE h >= 0 AND h <= 0.28e0 END AS removed FROM own CROSS JOIN (SELECT unnest([{_POLICIES}]) AS policy)),
k AS (SELECT *, CASE WHEN NOT in_prior AND NOT removed THEN x END AS kx, CASE WHEN NOT in_prior AND NOT removed THEN y END AS ky, CASE WHEN NOT in_prior AND NOT removed THEN z END AS kz FROM p),
m AS (SELECT policy, frame, det, count(*) AS n_owned, count(*) FILTER (in_prior) AS n_temporal, count(*) FILTER (NOT in_prior AND removed) AS n_occupancy, count(kx) AS n_kept,
  (quantile_cont(kx, 0.05) + quantile_cont(kx, 0.95)) / 2 AS cx, (quantile_cont(ky, 0.05) + quantile_cont(ky, 0.95)) / 2 AS cy, (quantile_cont(kz, 0.05) + quantile_cont(kz, 0.95)) / 2 AS cz,
  greatest(max(kx) - min(kx), max(ky) - min(ky)) AS hspan, max(kz) - min(kz) AS vspan FROM k GROUP BY policy, frame, det)
SELECT frame, det, n_owned, n_temporal, n_occupancy, n_kept, {", ".join(f"round(CASE WHEN n_kept >= 3 THEN {c} END, 6) AS {c}" for c in ("cx", "cy", "cz", "hspan", "vspan"))}, n_kept >= 3 AS measured, policy, frame // 100 AS scene FROM m""")  # fmt: skip
def job2_policy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = _folder(spark, "job2"), json.loads(policy_replay.CONFIG.read_text())
    for _ in range(2):
        policy_replay.run(spark, sf_dir, folder, config)
    out = spark.read.schema(policy_replay.OUTPUT).parquet(folder)
    return out.select("frame", "det", "n_owned", "n_temporal", "n_occupancy", "n_kept", *[r6(c) for c in ("cx", "cy", "cz", "hspan", "vspan")], "measured", "policy", F.col("scene"))
