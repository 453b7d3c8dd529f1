"""Stage traces of boxes, and the exclusive reasons that follow from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusegrid.functions import boxes as B
from fusegrid.functions import geometry as G
from fusegrid.functions import model as M
from fusegrid.operators.aggregates import quantile

K = M.MIN_COMPONENT_POINTS


def first_of(*rules: tuple[Column, str], otherwise: str | Column | None = None) -> Column:
    """The name of the first rule that holds; rules that are null do not."""
    out = F
    for holds, name in rules:
        out = out.when(holds, name)
    return out if otherwise is None else out.otherwise(otherwise)


def stage_trace(points: DataFrame, detections: DataFrame, keys: Sequence[str] = ("frame",), cls: str = "PERSON") -> DataFrame:
    """For each box, how many points stand at each stage, whoever owns them, and how many it owns.

    points: u, v, valid, depth, h, temporal_keep, occupancy_keep and owner (null: none).  Boxes without any point have zeros.
    """
    inside = B.inside("u", "v", B.box("")) & F.col("valid") & (F.col("depth") > 0)
    return stage_counts(points.join(detections, list(keys)).where(inside), detections, keys, cls)


def stage_counts(inside: DataFrame, detections: DataFrame, keys: Sequence[str] = ("frame",), cls: str = "PERSON") -> DataFrame:
    """``stage_trace`` of rows that hold a point and a box that contains it."""
    seen = G.in_view("u", "v", "depth") & G.within("h", M.BROAD_HEIGHT)
    tall = G.within("h", M.CLASS_HEIGHT[cls])
    both, own = F.col("temporal_keep") & F.col("occupancy_keep"), F.coalesce(F.col("owner") == F.col("det"), F.lit(False))
    here = seen & tall
    stages = {
        "raw": F.lit(True), "post_height": here, "post_temporal": here & F.col("temporal_keep"), "post_occupancy": here & F.col("occupancy_keep"), "post_both": here & both,
        "owned_before": here & own, "owned": here & own & both, "stolen": here & both & F.col("owner").isNotNull() & ~own, "height_removed": seen & ~tall,
    }
    counted = inside.groupBy(*keys, "det").agg(*[F.count_if(c).alias(n) for n, c in stages.items()])
    return detections.select(*keys, "det").join(counted, [*keys, "det"], "left").fillna(0, list(stages))


def stage_miss(stage: Mapping[str, Column], lost_later: Column | str) -> Column:
    """Why a box led to no measurement: stage has before, after, clusters, fit; what none of these explains is ``lost_later``."""
    return first_of(
        (stage["before"] < K, "A_NO_PROJECTED_POINTS_IN_BOX"), (stage["after"] < K, "B_SUPPRESSION_LEAVES_TOO_FEW_POINTS"),
        (stage["clusters"] == 0, "C_CLUSTERING_FAILS"), (~stage["fit"], "D_SHAPE_OR_QUALITY_GATE"), otherwise=lost_later,
    )


def target_miss(has_box: Column, stage: Mapping[str, Column], available: Column) -> Column:
    """Why a target was missed, from the box that stands for it, if any."""
    later = F.when(available, "E_COMPONENT_ASSIGNMENT_FAILS").otherwise("F_TRACKING_ASSOCIATION_FAILURE")
    return F.when(~has_box, "A_NO_PROJECTED_POINTS_OR_PERSON_BOX").otherwise(stage_miss(stage, later))


def false_positive_kind(competition: Column, in_robot: Column, height: Column, hspan: Column, vspan: Column, near_other: Column) -> Column:
    return first_of(
        (competition, "neighbor_person_contamination"), (in_robot, "robot_contamination"), ((height < 0.25) | (vspan < 0.10), "wall_or_floor"),
        ((hspan > 0.9) & (height < 1.4), "furniture_or_static_structure"), (near_other, "split_person"), otherwise="unknown",
    )


def proxy_class(covering: Column, measured: Column, nearest: Column) -> Column:
    """Class of a miss after the run: boxes that cover the target, how many of them have a position, and the nearest one's distance."""
    return first_of(
        (covering == 0, "A_COCO_BOX_MISS_OR_PROJECTION_PROXY_MISMATCH"), (measured == 0, "B_BOX_PRESENT_NO_LIDAR_COMPONENT"),
        (nearest > M.GT_GATE_M, "C_COMPONENT_XYZ_OUTSIDE_1P5M_GATE"), otherwise="D_SHORT_TRACKER_OR_STATE_ASSOCIATION_FAILURE",
    )


#: Columns of a correspondence case: ratios of the proxy's sides to the box's, overlaps, distances in box units, and flags.
CASE_NUMBERS = ("width_ratio", "height_ratio", "iou", "over_smaller", "center_norm", "margin", "neighbor_iou", "conf", "du", "dv")
CASE_FLAGS = ("center_in_box", "box_center_in_proxy", "proxy_at_border", "box_at_border", "closer_to_other", "close_neighbor", "occluded", "has_second")


def size_log() -> Column:
    return F.greatest(F.abs(F.ln("width_ratio")), F.abs(F.ln("height_ratio")))


def freeze_subtype_rules(matched: DataFrame, missed: DataFrame) -> DataFrame:
    """One row of limits, learnt from training cases of matched and of missed targets only."""
    at = lambda c, p: quantile(c, p)
    t = matched.withColumn("size_log", size_log()).agg(
        F.greatest(F.lit(0.03), at("iou", 0.1)).alias("r_iou"), at("center_norm", 0.9).alias("r_center"), at("width_ratio", 0.1).alias("r_w1"), at("width_ratio", 0.9).alias("r_w2"),
        at("height_ratio", 0.1).alias("r_h1"), at("height_ratio", 0.9).alias("r_h2"), F.greatest(F.lit(0.2), at("over_smaller", 0.1)).alias("r_overlap"),
        F.greatest(F.lit(0.35), at("size_log", 0.95)).alias("r_size"), F.greatest(F.lit(0.05), at("margin", 0.1)).alias("r_margin"),
    )
    shift = [e for c in ("du", "dv") for e in (at(c, 0.5).alias(f"r_{c}"), (at(c, 0.75) - at(c, 0.25)).alias(f"r_{c}_iqr"))]
    same_sign = F.greatest(F.avg((F.col("du") >= 0).cast("double")), F.avg((F.col("du") <= 0).cast("double")))
    return t.crossJoin(missed.agg(*shift, (same_sign >= 0.8).alias("r_constant")))


def subtype(rules: Mapping[str, Column] | None = None) -> Column:
    """The exclusive subtype of a case beside the frozen limits (columns r_*)."""
    c = {k: F.col(k) for k in (*CASE_NUMBERS, *CASE_FLAGS)} | {k: F.col(f"r_{k}") for k in ()}
    r = rules or {k: F.col(f"r_{k}") for k in ("iou", "center", "w1", "w2", "h1", "h2", "overlap", "size", "margin", "du", "dv", "du_iqr", "dv_iqr", "constant")}
    size = size_log()
    touches = c["center_in_box"] | c["box_center_in_proxy"] | (c["over_smaller"] >= r["overlap"])
    truncated = c["proxy_at_border"] | (c["box_at_border"] & touches)
    two_fit = c["has_second"] & (c["margin"] <= r["margin"]) & (c["closer_to_other"] | c["close_neighbor"] | (touches & (c["neighbor_iou"] > 0)))
    usual_size = c["width_ratio"].between(r["w1"], r["w2"]) & c["height_ratio"].between(r["h1"], r["h2"])
    like_matched = c["center_in_box"] | c["box_center_in_proxy"] | (c["iou"] >= r["iou"]) | ((c["center_norm"] <= r["center"]) & usual_size)
    in_band = lambda k: F.abs(c[k] - r[k]) <= F.greatest(F.lit(10.0), r[f"{k}_iqr"] * 1.5)
    return first_of(
        (truncated, "TRUNCATED_OR_BORDER"), (two_fit, "AMBIGUOUS_CORRESPONDENCE"), (like_matched & ~c["occluded"] & (size <= r["size"]), "CRITERION_TOO_STRICT"),
        (r["constant"] & in_band("du") & in_band("dv") & (size <= r["size"]) & ~c["occluded"], "SYSTEMATIC_REGISTRATION"),
        ((c["over_smaller"] >= r["overlap"]) & ((size > r["size"]) | c["occluded"]), "EXTENT_SEMANTICS"),
        ((c["conf"] >= 0.5) & (c["over_smaller"] < 0.1) & (size > r["size"] * 1.5) & ~c["occluded"], "EXTREME_DETECTION"), otherwise="UNRESOLVED",
    )


def promotion_checks(v: Mapping[str, Column], base: Mapping[str, Column]) -> dict[str, Column]:
    """What a variant (f1, precision, fp, rmse, p95, duplicates, transitions, time_p95) must hold beside the base to be promoted."""
    return {
        "f1_strictly_improves": v["f1"] > base["f1"], "precision_within_0_002": v["precision"] >= base["precision"] - 0.002, "fp_increase_at_most_5": v["fp"] - base["fp"] <= 5,
        "xy_rmse_not_worse_by_0_02m": v["rmse"] <= base["rmse"] + 0.02, "xy_p95_not_worse_by_0_05m": v["p95"] <= base["p95"] + 0.05, "no_duplicate_gt_occupation": v["duplicates"] == 0,
        "no_neighbor_identity_transition": v["transitions"] == 0, "time_p95_below_100ms": v["time_p95"] < 100.0,
    }


def duplicate_occupations(predictions: DataFrame, targets: DataFrame, matched: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Recovered predictions without a target that stand within the gate of one that an ordinary prediction has.

    predictions: pred, source, x, y, z; targets: gt, x, y, z; matched: pred, gt.
    """
    held = matched.join(predictions.where("source = 'NORMAL_COMPONENT'").select(*keys, "pred"), [*keys, "pred"], "left_semi").join(targets, [*keys, "gt"])
    held = held.select(*keys, *[F.col(c).alias(f"t{c}") for c in "xyz"])
    free = predictions.where("source = 'RECOVERED_SUPPRESSED_COMPONENT'").join(matched.select(*keys, "pred"), [*keys, "pred"], "left_anti")
    d2 = sum((F.pow(F.col(c) - F.col(f"t{c}"), 2) for c in "xyz"), F.lit(0.0))
    return free.join(held, list(keys)).where(F.sqrt(d2) <= M.GT_GATE_M).select(*keys, "pred").distinct()
