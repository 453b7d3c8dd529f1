"""The sensor relations that the registered queries run on, derived from the test tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.functions import geometry as G

ROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, pid (within the frame), x, y, z of one point for each line item."""
    t = table(spark, sf_dir, "lineitem").select(*ROW)
    k, n, p, s = (F.col(c).cast("long") for c in ROW)
    frame = F.floor(k / 125).cast("long")
    t = t.withColumn("frame", frame)
    pid = F.row_number().over(W.partitionBy("frame").orderBy(*ROW))
    return t.select("frame", pid.cast("long").alias("pid"), (F.pmod(p * 37 + n * 11, F.lit(900)) / 100 + 1).alias("x"), (F.pmod(s * 53 + k * 17, F.lit(800)) / 100 - 4).alias("y"), (F.pmod(p * 13 + s * 29, F.lit(240)) / 100 - 2.2).alias("z"))


def projected(points_: DataFrame, shift: str = "inference") -> DataFrame:
    """Points with u, v, valid, depth and height h."""
    return G.with_projection(points_, shift=shift).withColumn("h", G.ground_height("x", "y", "z"))


def boxes(points_: DataFrame) -> DataFrame:
    """Four person boxes for each frame."""
    b = points_.select("frame").distinct().withColumn("det", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    f, k = F.col("frame"), F.col("det")
    x1, y1 = F.pmod(f * 131 + k * 257, F.lit(1000)).cast("double"), F.pmod(f * 71 + k * 97, F.lit(400)).cast("double")
    return b.select("frame", "det", F.lit("PERSON").alias("cls"), x1.alias("x1"), y1.alias("y1"), (x1 + 120 + k * 30).alias("x2"), (y1 + 240 + k * 20).alias("y2"), ((F.pmod(f * 37 + k * 11, F.lit(70)) + 30) / 100).alias("conf"))


def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on a centimetre grid, one for each supplier."""
    k = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select((F.pmod(k * 379, F.lit(900)) / 100 + 1).alias("ox"), (F.pmod(k * 631, F.lit(800)) / 100 - 4).alias("oy"))


def events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """idx and time (us) of the events of one type: streams of images (view) and scans (click)."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("event_id").alias("idx"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of tracks: one for each event, the user as track."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("track"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", F.col("value").alias("x"), F.pmod(F.col("event_id") * 7, F.lit(13)).cast("double").alias("y"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three predictions for each frame."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")).where("k % 8 <> 0")
    f, i = F.floor(F.col("k") / 3).cast("long"), F.pmod("k", F.lit(3)).cast("int")
    return c.select(f.alias("frame"), i.alias("pred"), *_place("k", 7, 11, 13))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three targets for each frame, near the predictions for most."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")).where("k % 11 <> 0")
    f, i = F.floor(F.col("k") / 3).cast("long"), F.pmod("k", F.lit(3)).cast("int")
    return c.select(f.alias("frame"), i.alias("gt"), *_place("k", 7, 11, 13, 0.05))


def _place(k: str, a: int, b: int, c: int, nudge: float = 0.0) -> list:
    n = F.col(k)
    off = F.pmod(n * 31, F.lit(47)) * nudge
    return [(F.pmod(n * a * 17, F.lit(997)) / 100 + off).alias("x"), (F.pmod(n * b * 19, F.lit(991)) / 100 - off).alias("y"), (F.pmod(n * c * 3, F.lit(211)) / 100).alias("z")]


def log(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    """Two logs of one run: b leaves out, shifts and adds some of a's rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("k"), "o_orderstatus", "o_totalprice")
    a = o.select("frame", F.concat(F.lit("T"), F.pmod("k", F.lit(5)).cast("string")).alias("track_id"), F.round(F.col("o_totalprice") * 1e0, 2).alias("x"), F.col("o_orderstatus").alias("state"))
    if variant == "a":
        return a.where("frame % 11 <> 3")
    return a.where("frame % 7 <> 2").withColumn("x", F.when(F.col("frame") % 5 == 0, F.col("x") + 0.25).otherwise(F.col("x"))).withColumn("state", F.when(F.col("frame") % 13 == 0, None).otherwise(F.col("state")))
