"""Ledger of text records, kept up to date as files arrive.

Audits of a run rest on inputs that nobody changed since they were recorded.  This job reads the text
relations as file streams, takes the files that are new since its checkpoint, and writes
for each record its key, size, number of lines and SHA-256, and what the delivery means:

  new       the key was unknown
  known     the key came before with the same text
  changed   the key came before with another text (in its latest batch; the greatest digest, if that held several)
  conflict  this batch has several texts for the key
  unkeyed   a part of the key is null

``first_holder`` and ``first_batch`` name the first record, by batch and name, that had the same text,
so copies across relations show.  Rows of one batch that agree in key and text are one record with
``copies``.  A null text has no digest and no holder.

The ledger is partitioned by relation and batch.  A batch that is run again, after a failure
between its write and the checkpoint's, reads earlier batches only and overwrites its own partitions.

    python -m jobs.text_ledger --input DIR --output DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fusegrid.plans.scratch import discard, materialize

log = logging.getLogger("jobs.text_ledger")
CONFIG = Path(__file__).with_suffix(".json")
LEDGER = "key string, grp string, copies long, n_chars long, n_lines long, sha256 string, first_holder string, first_batch long, status string, relation string, batch long"
STATUSES = ("new", "known", "changed", "conflict", "unkeyed")


def records(rows: DataFrame, relation: dict) -> DataFrame:
    """relation, key, grp, sha256, n_chars and n_lines of each row; the text itself goes no further."""
    text = F.col(relation["text"])
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in relation["key"]])
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in relation["key"]])
    grp = F.col(relation["group"]) if relation["group"] else F.lit(None)
    return rows.select(
        F.lit(relation["name"]).alias("relation"), F.when(whole, key).alias("key"), grp.cast("string").alias("grp"), F.sha2(text, 256).alias("sha256"),
        F.length(text).cast("long").alias("n_chars"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
    )


def judge(held: DataFrame, known: DataFrame, batch: int) -> DataFrame:
    """The ledger's rows of a batch: ``held`` has one row for each (relation, key, sha256), ``known`` the ledger of earlier batches.

    Rows without a key or a text skip the joins, as they may be any share of the rows.
    """
    key = ["relation", "key"]
    holder = F.concat(F.col("relation"), F.lit("/"), F.col("key"))
    latest = known.where("key is not null").groupBy(*key).agg(F.max(F.struct("batch", "sha256")).alias("last"))
    several = held.where("key is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("texts"))
    now = held.where("key is not null and sha256 is not null").groupBy("sha256").agg(F.min(holder).alias("holder")).withColumn("at", F.lit(batch).cast("long"))
    before = known.where("first_holder is not null").groupBy("sha256").agg(F.min(F.struct("first_batch", "first_holder")).alias("f")).select("sha256", F.col("f.first_holder").alias("holder"), F.col("f.first_batch").alias("at"))
    first = now.unionByName(before).groupBy("sha256").agg(F.min(F.struct("at", "holder")).alias("first"))
    last = F.col("last")
    status = F.when(F.col("texts") > 1, "conflict").when(last.isNull(), "new").when(last["sha256"].eqNullSafe(F.col("sha256")), "known").otherwise("changed")
    keyed = held.where("key is not null").join(several, key).join(latest, key, "left").withColumn("status", status).drop("texts", "last")
    rows = keyed.unionByName(held.where("key is null").withColumn("status", F.lit("unkeyed")))
    found = rows.where("sha256 is not null").join(first, "sha256", "left").withColumns({"first_holder": F.col("first.holder"), "first_batch": F.col("first.at")}).drop("first")
    none = rows.where("sha256 is null").withColumns({"first_holder": F.lit(None).cast("string"), "first_batch": F.lit(None).cast("long")})
    columns = [c.split()[0] for c in LEDGER.split(", ")]
    return found.unionByName(none).withColumn("batch", F.lit(batch).cast("long")).select(*columns)


def read_ledger(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(output)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Take all files that are new since the checkpoint; returns batches, rows read, and records written by status."""
    totals = dict.fromkeys(("batches", "rows_read", "records", *STATUSES), 0)
    spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("relation", "batch").parquet(output)

    def write(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        seen, made = Observation(), Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows_read"))
        held = rows.groupBy("relation", "key", "sha256").agg(F.min("grp").alias("grp"), F.count(F.lit(1)).alias("copies"), F.max("n_chars").alias("n_chars"), F.max("n_lines").alias("n_lines"))
        held = materialize(held, "ledger")  # the texts are read and hashed once
        known = read_ledger(session, output).where(F.col("batch") < batch)
        out = judge(held, known, batch).observe(made, F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("relation", "batch").parquet(output)
        discard(held)
        counts = {"batches": 1, **seen.get, **made.get}
        log.info("batch %d: %s", batch, counts)
        for k, v in counts.items():
            totals[k] += v

    streams = []
    for relation in config["relations"]:
        path = f"{source}/{relation['name']}.parquet*"  # a pattern, as a file stream takes a folder or a pattern, never one file
        log.info("reading new files of %s", path)
        streams.append(records(spark.readStream.schema(relation["schema"]).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(path), relation))
    query = reduce(DataFrame.unionByName, streams).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("wrote %s: %s", output, totals)
    return totals


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True, help="a folder that all executors share, or any path that Spark reads")
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_ledger").getOrCreate()
    try:
        run(spark, a.input, a.output, a.checkpoint, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
