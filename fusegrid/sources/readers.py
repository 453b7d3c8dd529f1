"""File readers, binary decoders and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: point field codes of the cloud message
FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
POINTS = "path string, pid int, x double, y double, z double"


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as text, by an explicit schema; a byte order mark is dropped."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns))


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


LOG = "processed boolean, rgb_frame_id long, rgb_timestamp long, new_lidar_update boolean, latest_lidar_frame_id long, lidar_update_detail struct<lidar_frame_id:long>, persons array<struct<track_id:string,xyz_valid:boolean,position_xyz:array<double>,x:double,y:double,z:double>>"


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """Processed rows of a JSON-lines log, the last of each frame."""
    return last_processed(spark.read.schema(schema).json(path).withColumn("_at", F.monotonically_increasing_id()))


def last_processed(rows: DataFrame, order: str = "_at") -> DataFrame:
    row = F.struct(*[c for c in rows.columns if c != order])
    return rows.where("processed").groupBy("rgb_frame_id").agg(F.max_by(row, order).alias("r")).select("r.*")


def predictions(log: DataFrame) -> DataFrame:
    """(frame, pred, track_id, x, y, z): valid persons of the rows with a new scan; the last row of a scan stands."""
    frame = F.coalesce("lidar_update_detail.lidar_frame_id", "latest_lidar_frame_id")
    rows = log.where("processed and new_lidar_update").withColumn("frame", frame)
    last = rows.groupBy("frame").agg(F.max_by("persons", "rgb_frame_id").alias("persons"))
    p = last.select("frame", F.posexplode("persons").alias("pred", "p")).where("p.xyz_valid")
    at = lambda i, c: F.coalesce(F.col("p.position_xyz")[i], F.col(f"p.{c}"))
    return p.select("frame", "pred", "p.track_id", at(0, "x").alias("x"), at(1, "y").alias("y"), at(2, "z").alias("z"))


def decode_cloud(data: bytes, fields: list[tuple[str, int, int]], width: int, height: int, point_step: int, row_step: int, big_endian: bool) -> np.ndarray:
    """(n, 3) finite points of a packed cloud; fields are (name, byte offset, type code)."""
    order = ">" if big_endian else "<"
    by = {name: (offset, FIELD_TYPES[code]) for name, offset, code in fields}
    if not {"x", "y", "z"} <= set(by):
        raise ValueError("the cloud lacks x, y or z")
    kind = np.dtype({"names": list(by), "formats": [order + f for _, f in by.values()], "offsets": [o for o, _ in by.values()], "itemsize": point_step})
    rows = [np.frombuffer(data, kind, width, r * row_step) for r in range(height)]
    p = np.concatenate(rows) if rows else np.zeros(0, kind)
    xyz = np.stack([p[c].astype(float) for c in "xyz"], 1)
    return xyz[np.isfinite(xyz).all(1)]


def decode_pcd(blob: bytes) -> np.ndarray:
    """(n, 3) points of a binary PCD file with fields x y z as little-endian floats."""
    head, at = {}, 0
    while "DATA" not in head:
        end = blob.index(b"\n", at)
        words = blob[at:end].decode("ascii").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            head[words[0].upper()] = words[1:]
    if [f.lower() for f in head["FIELDS"]] != ["x", "y", "z"] or head["DATA"] != ["binary"]:
        raise ValueError("only binary x y z files are read")
    n = int(head["POINTS"][0])
    if len(blob) - at < 12 * n:
        raise ValueError("the file ends before its points")
    return np.frombuffer(blob, "<f4", 3 * n, at).reshape(n, 3).astype(float)


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """path, pid, x, y, z of all points of PCD files, a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, blob in zip(b.path, b.content, strict=True):
                p = decode_pcd(blob)
                yield pd.DataFrame({"path": name, "pid": np.arange(len(p), dtype=np.int32), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, POINTS)


def decode_image(data: bytes, width: int, height: int, step: int, encoding: str) -> np.ndarray:
    """(height, width, 3) blue-green-red bytes of an rgb8, bgr8 or mono8 message."""
    channels = {"rgb8": 3, "bgr8": 3, "mono8": 1}.get(encoding)
    if channels is None:
        raise ValueError(f"unsupported encoding {encoding}")
    if len(data) < step * height or step < width * channels:
        raise ValueError("the image is shorter than its header says")
    a = np.frombuffer(data, np.uint8, step * height).reshape(height, step)[:, : width * channels].reshape(height, width, channels)
    return a[..., ::-1] if encoding == "rgb8" else a if channels == 3 else np.repeat(a, 3, 2)


def load_profile(path: str, name: str) -> dict:
    """A dataset profile that is ready and of that name; only scene01 may bring its own priors."""
    with open(path, encoding="utf-8") as f:
        p = json.load(f)
    if p["dataset"] != name:
        raise ValueError("the profile is of another dataset")
    if p["adapter_status"] != "ready":
        raise ValueError(f"the adapter of {name} is not ready")
    if name != "scene01" and any(p.get("scene_specific_priors", {}).values()):
        raise ValueError("priors of scene01 may not be enabled for other scenes")
    return p


def write_csv(frames: Sequence[DataFrame], path: str) -> None:
    """One table under the union of all columns."""
    from fusegrid.operators.joins import union_schemas

    union_schemas(*frames).write.mode("overwrite").csv(path, header=True)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(metrics: dict, path: str, title: str) -> None:
    """A Markdown table of a run's few summary numbers."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {title}\n\n| metric | value |\n|---|---|\n" + "".join(f"| {k} | {v} |\n" for k, v in metrics.items()))


def write_summary(metrics: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(metrics, f, indent=2, sort_keys=True)


def resume(spark: SparkSession, path: str, expected: int, compute) -> DataFrame:
    """The table at ``path`` if it has the expected number of rows, else what ``compute()`` gives, written there."""
    try:
        held = spark.read.parquet(path)
        if held.count() == expected:
            return held
    except Exception as e:  # an absent path has several error classes, by file system
        if "PATH_NOT_FOUND" not in str(e):
            raise
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def valid_targets(targets: DataFrame, frames: DataFrame, per_frame: int | None = None) -> DataFrame:
    """The targets marked valid, of the frames in scope; with ``per_frame``, any other number of a frame raises."""
    t = targets.where(F.col("gt_valid") == "True").join(frames, "frame", "left_semi")
    if per_frame is None:
        return t
    n = t.groupBy("frame").agg(F.count(F.lit(1)).alias("_n"))
    complete = F.assert_true(F.col("_n") == per_frame, F.format_string("frame %d has %d targets", "frame", "_n"))
    return t.join(n, "frame").where(complete.isNull()).drop("_n")


def payload_signatures(messages: DataFrame, payload: Sequence[str], expected: dict[str, float]) -> DataFrame:
    """One row: messages, distinct payloads, and the greatest deviation of the expected fields from their constants."""
    error = F.greatest(*[F.abs(F.col(c) - v) for c, v in expected.items()]) if len(expected) > 1 else [F.abs(F.col(c) - v) for c, v in expected.items()][0]
    return messages.agg(F.count(F.lit(1)).alias("messages"), F.countDistinct(F.to_json(F.struct(*payload))).alias("signatures"), F.round(F.max(error), 6).alias("max_error"))


def frozen_prior(spark: SparkSession, path: str, receipt: dict, least: float) -> DataFrame:
    """The voxels of a frozen prior that are frequent enough; the receipt must name its split, frames and content.

    The content is a SHA-256 over the voxels in order, so a changed file raises.
    """
    prior = spark.read.parquet(path)
    if receipt.get("fit_scope") != "TRAIN_FIT" or int(receipt.get("validation_updates", 0)):
        raise ValueError("the prior was not fitted on the training split alone")
    if content_sha256(prior, ["kx", "ky", "kz"], ["kx", "ky", "kz", "n_frames"]) != receipt["sha256"]:
        raise ValueError("the prior is not the one of its receipt")
    return prior.where(F.col("n_frames") / int(receipt["frame_count"]) >= least)


def content_sha256(rows: DataFrame, order: Sequence[str], fields: Sequence[str], blocks: int = 64) -> str:
    """SHA-256 of a table's content, whatever its files: digests of blocks by hash, then of those."""
    from fusegrid.operators.aggregates import fingerprint

    block = F.pmod(F.xxhash64(*order), F.lit(blocks))
    return fingerprint(rows.withColumn("_block", block), order, fields, "_block").first()[0] or ""


def prototypes(spark: SparkSession, path: str) -> DataFrame:
    """(name, vector) of prototypes fitted on the training split; any other scope raises."""
    p = spark.read.parquet(path)
    ok = F.assert_true(F.col("fit_scope") == "TRAIN_FIT", F.concat(F.lit("prototypes of another scope: "), F.coalesce("fit_scope", F.lit("none"))))
    return p.where(ok.isNull()).select("name", "vector")
