"""Replay of a recording under several background policies.

For each policy, each frame and each person box: how many of the box's points the temporal prior
and the occupancy prior take away, how many stay, and the robust centre and spans of those that stay.  So one sees which
boxes lose their measurement under which policy, over the whole recording or over some of its scenes.

Points are projected, gated and given to boxes once; the points that boxes own are flagged against both
priors, written once to the shared folder, and every policy reads that table.  The output is partitioned by policy and scene; a run
overwrites the partitions it makes and no others, so it can be repeated, and scenes can be replayed again by
themselves.  The temporal prior is always that of the whole recording.  ``frames_per_scene`` sets the size of partitions: choose
it so that a scene makes a file of a useful size.

    python -m jobs.policy_replay --input DIR --output DIR [--config FILE] [--first-scene N] [--last-scene N]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fusegrid.functions import geometry as G
from fusegrid.functions import model as M
from fusegrid.operators import aggregates as A
from fusegrid.operators import audit, cluster, joins
from fusegrid.plans.scratch import discard, materialize
from fusegrid.sources import relations as R

log = logging.getLogger("jobs.policy_replay")
CONFIG = Path(__file__).with_suffix(".json")
OUTPUT = "frame long, det int, n_owned long, n_temporal long, n_occupancy long, n_kept long, cx double, cy double, cz double, hspan double, vspan double, measured boolean, policy string, scene long"


def owned_points(spark: SparkSession, source: str, config: dict) -> DataFrame:
    """Points that a person box owns, of the scenes asked for, with scene, in_prior and near."""
    points = R.points(spark, source)
    voxel = dict(zip(("kx", "ky", "kz"), G.voxel("x", "y", "z", size=config["voxel_m"]), strict=True))
    prior = A.frequent_voxels(points.withColumns(voxel), "frame", ("kx", "ky", "kz"), config["prior_share"], config["prior_frames"])
    scene = F.floor(F.col("frame") / config["frames_per_scene"])
    first, last = config["first_scene"], config["last_scene"]
    asked = points.where((F.lit(first is None) | (scene >= (first or 0))) & (F.lit(last is None) | (scene <= (last or 0))))
    gated = R.projected(asked).where(F.col("valid") & G.in_view("u", "v", "depth") & G.within("h", M.BROAD_HEIGHT))
    owned = joins.owners(gated, R.boxes(asked)).select("frame", "det", "pid", "x", "y", "z", "h").withColumns(voxel)
    owned = joins.voxel_flag(owned, joins.small(materialize(prior, "replay-prior")))
    return joins.near_flag(owned, R.occupancy(spark, source), config["occupancy_radius_m"]).withColumn("scene", scene).drop("kx", "ky", "kz")


def measurements(owned: DataFrame, policies: list[str], min_points: int) -> DataFrame:
    """A row for each policy and box that owns any point; points are counted and measured once for all policies, not once for each."""
    box, free = ["scene", "frame", "det"], ~F.col("in_prior")
    clear = {k: audit.occupancy_keep(F.lit(k), "z", "h", "near", free, F.lit(True)) for k in policies}
    g = owned.groupBy(*box).agg(F.count(F.lit(1)).alias("n_owned"), F.count_if("in_prior").alias("n_temporal"))
    m = cluster.kept_measurements(owned.withColumns({k: free & c for k, c in clear.items()}), policies, box, "pid")
    g = g.join(m, box).withColumnsRenamed({"keep": "policy", "n": "n_kept"}).withColumn("n_occupancy", F.col("n_owned") - F.col("n_temporal") - F.col("n_kept"))
    measured = F.col("n_kept") >= min_points
    g = g.withColumns({c: F.when(measured, F.col(c)) for c in ("cx", "cy", "cz", "hspan", "vspan")}).withColumn("measured", measured)
    return g.select(*[c.split()[0] for c in OUTPUT.split(", ")])


def run(spark: SparkSession, source: str, output: str, config: dict) -> dict[str, int]:
    """Replay the scenes asked for; returns the boxes, and those measured under each policy."""
    if unknown := set(config["policies"]) - set(M.POLICIES):
        raise ValueError(f"unknown policies: {sorted(unknown)}")
    log.info("reading %s/lineitem.parquet as points, %s/supplier.parquet as occupied places", source, source)
    owned = materialize(owned_points(spark, source, config), "replay-flagged")
    made = Observation()
    out = measurements(owned, config["policies"], config["min_points"])
    out = out.observe(made, F.count(F.lit(1)).alias("rows"), F.sum("n_owned").alias("points"), *[F.count_if(F.col("measured") & (F.col("policy") == p)).alias(p) for p in config["policies"]])
    # a task writes a file for each of its partitions, so small ones are not put together in few tasks
    out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "policy", "scene").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("policy", "scene").parquet(output)
    discard(owned)
    counts = {k: v or 0 for k, v in made.get.items()}
    log.info("wrote %s: %s", output, counts)
    return counts


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output"):
        p.add_argument(f"--{name}", required=True, help="a path that Spark reads")
    p.add_argument("--config", default=str(CONFIG))
    for name in ("first_scene", "last_scene"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=None)
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(a.config).read_text())
    config |= {k: v for k in ("first_scene", "last_scene") if (v := getattr(a, k)) is not None}
    spark = SparkSession.builder.appName("policy_replay").getOrCreate()
    try:
        run(spark, a.input, a.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
