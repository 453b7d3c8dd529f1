"""Suppression policies, decision ladders, taxonomies, searches and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusegrid.functions import model as M


def occupancy_keep(policy: Column, z, h, near, temporal_keep, person_owned, low: float = M.OCCUPANCY_LOW_M, high: float = M.OCCUPANCY_HIGH_M) -> Column:
    """Whether occupancy keeps a point, under the policy named by a column; an unknown name raises.

    LEGACY bands the difference of z and height, a known dimensional slip that production keeps.
    """
    z, h, near, temporal, person = (F.col(c) if isinstance(c, str) else c for c in (z, h, near, temporal_keep, person_owned))
    banded = lambda v: (v <= low) | (v >= high)
    ground = (h >= 0) & (h <= low)
    restored = temporal & person & h.between(*M.CLASS_HEIGHT["PERSON"])
    remove = (
        F.when(policy == "LEGACY", banded(z - h))
        .when(policy == "PHYSICAL_DIRECT", banded(h))
        .when(policy.isin("GROUND_LIMITED", "HEIGHT_BANDED"), ground)
        .when(policy == "TEMPORAL_PRIMARY_OCCUPANCY_SECONDARY", ~temporal & ground)
        .when(policy == "PERSON_CONDITIONAL_PROTECTION", banded(h) & ~restored)
        .otherwise(F.raise_error(F.concat(F.lit("unknown occupancy policy: "), policy)).cast("boolean"))
    )
    return ~(near & remove)


def candidate_quality(present, n, inside, plausible, score, competition, ambiguous) -> Column:
    """The first failing reason of a recovery candidate, or null."""
    c = [F.col(x) if isinstance(x, str) else x for x in (present, n, inside, plausible, score, competition, ambiguous)]
    return (
        F.when(~c[0], "NO_OCCUPANCY_DELETED_COMPONENT").when(c[1] < 3, "TOO_FEW_POINTS").when(~c[2], "CENTER_OUTSIDE_ORIGINAL_BOX").when(~c[3], "IMPLAUSIBLE_3D_SIZE")
        .when(c[4] > M.ASSOCIATION_LIMIT, "COMPONENT_SCORE_ABOVE_EXISTING_ASSIGNMENT_LIMIT").when(c[5], "NEIGHBOR_PERSON_COMPETITION").when(c[6], "AMBIGUOUS_COMPONENT_RANKING")
    )


#: fixed values: the cause that a rejected recovery stands for
RECOVERY_CAUSE = {
    "NO_METRIC_HISTORY": "E1_NO_HISTORY_SUPPORT",
    "NO_OCCUPANCY_DELETED_COMPONENT": "E2_RECOVERY_NO_VALID_COMPONENT",
    "TOO_FEW_POINTS": "E2_RECOVERY_NO_VALID_COMPONENT",
    "HISTORY_MOTION_GATE_REJECT": "E3_RECOVERY_MOTION_GATE_REJECT",
    "CENTER_OUTSIDE_ORIGINAL_BOX": "E4_RECOVERY_COMPONENT_QUALITY_REJECT",
    "IMPLAUSIBLE_3D_SIZE": "E4_RECOVERY_COMPONENT_QUALITY_REJECT",
    "COMPONENT_SCORE_ABOVE_EXISTING_ASSIGNMENT_LIMIT": "E4_RECOVERY_COMPONENT_QUALITY_REJECT",
    "AMBIGUOUS_COMPONENT_RANKING": "E4_RECOVERY_COMPONENT_QUALITY_REJECT",
    "NORMAL_SIGNATURE_UNAVAILABLE": "E4_RECOVERY_COMPONENT_QUALITY_REJECT",
    "HISTORY_COMPONENT_SIGNATURE_REJECT": "E4_RECOVERY_COMPONENT_QUALITY_REJECT",
    "NEIGHBOR_PERSON_COMPETITION": "E5_RECOVERY_NEIGHBOR_CONFLICT_REJECT",
}


def miss_cause(c: Mapping[str, Column]) -> Column:
    """The primary cause of a missed target; codes are exclusive and every row gets one.

    Columns: n_person, matched_box, raw, post_height, post_both, owned, stolen, clusters, selected,
    recovery_reason, recovery_accepted, has_prediction, selected_distance, best_distance,
    best_rank, prediction_matched, near_predictions.
    """
    k, gate = M.MIN_COMPONENT_POINTS, M.GT_GATE_M
    recovery = F.create_map(*[F.lit(x) for pair in RECOVERY_CAUSE.items() for x in pair])[c["recovery_reason"]]
    rejected = c["recovery_reason"].isNotNull() & recovery.isNotNull() & ~F.coalesce(c["recovery_accepted"], F.lit(False))
    return (
        F.when(c["n_person"] == 0, "A1_NO_PERSON_DETECTION").when(~c["matched_box"], "A2_PERSON_BOX_GEOMETRY_MISMATCH")
        .when(c["raw"] == 0, "B1_NO_RAW_PROJECTED_POINTS").when(c["raw"] < k, "B2_RAW_LIDAR_TOO_SPARSE")
        .when(c["post_height"] < k, "C_GEOMETRIC_OR_HEIGHT_GATE_REMOVAL").when(c["post_both"] < k, "D_STATIC_SUPPRESSION_REMOVAL")
        .when(rejected, recovery).when((c["owned"] >= k) & (c["clusters"] == 0), "F_CLUSTERING_FAIL")
        .when((c["owned"] < k) & (c["stolen"] > 0), "H_POINT_OWNERSHIP_CONFLICT").when((c["clusters"] > 0) & ~c["selected"], "G1_NO_COMPONENT_PASSED_SCORING")
        .when(~c["has_prediction"], F.coalesce(recovery, F.lit("G1_NO_COMPONENT_PASSED_SCORING")))
        .when((c["selected_distance"] > gate) & (c["best_distance"] <= gate) & (c["best_rank"] > 1), "G3_CORRECT_COMPONENT_LOST_RANKING")
        .when((c["selected_distance"] > gate) & (c["best_distance"] <= gate), "G2_WRONG_COMPONENT_RANKED_FIRST")
        .when(c["prediction_matched"], "I2_PREDICTION_MATCHED_ANOTHER_GT").when(c["near_predictions"] > 1, "I3_DUPLICATE_OR_MERGED_DETECTION_COMPETITION")
        .when(c["near_predictions"] == 1, "I4_GLOBAL_ASSIGNMENT_COMPETITION").otherwise("I1_NEAREST_PREDICTION_OUTSIDE_GATE")
    )


def suppression_detail(post_temporal: Column, post_occupancy: Column) -> Column:
    k = M.MIN_COMPONENT_POINTS
    return F.when((post_temporal < k) & (post_occupancy < k), "D3_BOTH").when(post_temporal < k, "D1_TEMPORAL").otherwise("D2_OCCUPANCY")


def joined_flags(flags: Mapping[str, Column]) -> Column:
    """The names of the flags that hold, joined by semicolons."""
    return F.concat_ws(";", *[F.when(c, name) for name, c in flags.items()])


def best_configuration(rows: DataFrame, keys: Sequence[str], name: str, order: Sequence[Column]) -> DataFrame:
    """The configuration of greatest order tuple in each group; list a final tie-break."""
    best = F.max_by(name, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias(name)
    return rows.groupBy(*keys).agg(best)


def gate(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Each check as a boolean column, null as false, and ``passed`` if all hold."""
    out = rows.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()})
    held = F.lit(True)
    for k in checks:
        held = held & F.col(k)
    return out.withColumn("passed", held)


#: fixed values: the runtime gate's limits (Hz, shares, ms, frames)
OUTPUT_HZ, PROCESSED, LIDAR_HZ, LIDAR_P95_MS, WALL_RATIO = 29.0, 0.99, (9.5, 10.5), 100.0, (0.95, 1.1)


def runtime_checks(realtime: bool = False, lightweight: bool = False, render_capacity: int = 1, video_capacity: int = 12) -> dict[str, Column]:
    """The runtime gate of a run: thirteen checks, and four more of the person-only mode.

    Columns: output_hz, processed_fraction, lidar_hz, lidar_p95_ms, wall_ratio, queue_growth, render_depth, video_depth, recording, video_dropped,
    video_written, processed, future_reads, repeated_timestamps, unknown_sources, duplicate_identities, robot_z_rows, rgb_count, rgb_expected,
    lidar_count, lidar_expected; for the person-only mode also robot_rows, reid, persistent and other_ids.
    """
    c, none = F.col, lambda x: F.col(x) == 0
    checks = {
        "rgb_output_rate_pass": c("output_hz") >= OUTPUT_HZ,
        "rgb_processed_fraction_pass": c("processed_fraction") >= PROCESSED,
        "lidar_update_rate_pass": c("lidar_hz").between(*LIDAR_HZ),
        "lidar_p95_pass": c("lidar_p95_ms") < LIDAR_P95_MS,
        "bounded_queue_pass": ~c("queue_growth") & (c("render_depth") <= render_capacity) & (c("video_depth") <= video_capacity),
        "recording_complete_pass": ~c("recording") | (none("video_dropped") & (c("video_written") == c("processed"))),
        "no_future_sensor_access_pass": none("future_reads"),
        "timestamp_monotonic_unique_pass": none("repeated_timestamps"),
        "state_source_pass": none("unknown_sources"),
        "no_duplicate_fixed_g_pass": none("duplicate_identities"),
        "robot_z_unavailable_pass": none("robot_z_rows"),
        "declared_scope_count_pass": (c("rgb_count") == c("rgb_expected")) & (c("lidar_count") == c("lidar_expected")),
        "runtime_mode_pass": c("wall_ratio").between(*WALL_RATIO) if realtime else c("output_hz") >= OUTPUT_HZ,
    }
    if lightweight:
        checks |= {"robot_inference_zero_pass": none("robot_rows"), "reid_disabled_pass": ~c("reid"), "persistent_identity_disabled_pass": ~c("persistent"), "temporary_t_ids_only_pass": none("other_ids")}
    return checks


def run_status(passed: Column, stopped: Column, realtime: bool = False, lightweight: bool = False, full: bool = False) -> Column:
    """The status of a run: its mode, then PASS, or FAIL if a check fails or the user stopped it."""
    mode = ("FULL_REALTIME" if realtime else "FULL_UNCAPPED") if full else "30HZ"
    prefix = ("PERSON_ONLY_LIGHTWEIGHT_" if lightweight else "PURE_ONLINE_") + mode
    return F.concat(F.lit(prefix + "_"), F.when(passed & ~stopped, "PASS").otherwise("FAIL"))


def long_form(metrics: DataFrame, name: str, a: str, b: str, fields: Sequence[str]) -> DataFrame:
    """(metric, a, b, delta) from one row per run."""
    long = metrics.unpivot([name], list(fields), "metric", "value")
    wide = long.groupBy("metric").pivot(name, [a, b]).agg(F.first("value"))
    return wide.withColumn("delta", F.col(b) - F.col(a))


def split_of(frame: Column, n_frames: Column) -> Column:
    """The split of a frame by its share of the sequence."""
    f = frame / n_frames
    return F.when(f < 0.5, "TRAIN_FIT").when(f < 0.6, "TRAIN_CALIBRATION").when(f < 0.8, "VALIDATION").when(f < 0.85, "EMBARGO").otherwise("TEST")


def guard_splits(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """The rows; reading one of a split that is not allowed raises."""
    ok = F.assert_true(F.col("split").isin(list(allowed)), F.concat(F.lit("split must not be reached: "), F.col("split")))
    return rows.where(ok.isNull())


def contiguous(rows: DataFrame, index: str) -> DataFrame:
    """One row: count, max, and whether the indices are exactly 0 to the last."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(index).alias("last"), ((F.count(F.lit(1)) == F.max(index) + 1) & (F.countDistinct(index) == F.count(F.lit(1))) & (F.min(index) == 0)).alias("contiguous"))


def check_expected(rows: DataFrame, expected: DataFrame, key: str, exact: Sequence[str], near: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """The expected rows with ``agrees``: exact fields equal and near ones within the tolerance; false where a row is missing."""
    e = expected.select(key, *[F.col(c).alias(f"e_{c}") for c in (*exact, *near)])
    ok = F.lit(True)
    for c in exact:
        ok = ok & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    for c in near:
        ok = ok & (F.abs(F.col(c) - F.col(f"e_{c}")) <= tolerance)
    return e.join(rows, key, "left").select(key, F.coalesce(ok, F.lit(False)).alias("agrees"))
