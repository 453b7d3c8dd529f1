"""Constants of the sensor model and row types."""

from __future__ import annotations

import numpy as np

# fixed values: camera matrix, distortion, rigid transforms and ground plane of the calibrated rig
FX, FY, CX, CY = 638.7348022460938, 637.01904296875, 631.7426147460938, 376.0455017089844
DISTORTION = (-0.05481167882680893, 0.06478200852870941, -0.0008851818274706602, -0.00027690528077073395, -0.020605145022273064)
RSLIDAR_FROM_COLOR = np.array([[1.0, 0.0, 0.0, 0.04], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, -0.07], [0.0, 0.0, 0.0, 1.0]])
COLOR_FROM_OPTICAL = np.array([[0.0007963267107333194, 0.0007963264582435126, 0.99999936586377, 0.0], [-0.9999996829318347, 6.341362301376385e-07, 0.0007963264582435126, 0.0], [5.551115123125783e-17, -0.9999996829318347, 0.0007963267107333194, 0.0], [0.0, 0.0, 0.0, 1.0]])
ANNOTATED_FROM_RSLIDAR = np.array([[0.965925826271113, 4.13984163700004e-11, 0.25881904516953275, -3.686162486360445e-11], [-3.9411981290630505e-11, 0.9999999999999998, -1.2864071446132213e-11, 1.1739287320011726e-10], [-0.2588190451695328, 2.2251567787446797e-12, 0.9659258262711125, 5.7131188668790855e-11], [0.0, 0.0, 0.0, 1.0]])
GROUND_NORMAL, GROUND_D = (0.004778112556410801, -0.01588542865538492, 0.9998624019318024), 2.1782561937946485
OPTICAL_FROM_ANNOTATED = np.linalg.inv(COLOR_FROM_OPTICAL) @ np.linalg.inv(RSLIDAR_FROM_COLOR) @ np.linalg.inv(ANNOTATED_FROM_RSLIDAR)

# fixed values: image, registration shifts, time limits
WIDTH, HEIGHT = 1280, 720
SHIFTS = {"physical": (0.0, 0.0), "inference": (64.0, 36.0), "display": (60.0, 17.0), "legacy_display": (48.0, 0.0)}
SYNC_SLOP_MS, HORIZON_MS, BACKLOG_MS = 35.0, 180.0, 180.0
FRESH_NS = 180_000_000

# fixed values: height gates by class, priors, components, scores
BROAD_HEIGHT = (0.03, 2.15)
CLASS_HEIGHT = {"PERSON": (0.08, 2.15), "ROBOT": (0.03, 1.35)}
VOXEL_M, VOXEL_FREQUENCY = 0.12, 0.65
OCCUPANCY_RADIUS_M, OCCUPANCY_LOW_M, OCCUPANCY_HIGH_M = 0.07, 0.28, 1.90
COMPONENT_RADIUS = (0.18, 0.02)
MIN_COMPONENT_POINTS = 3
CENTER_QUANTILES = (0.05, 0.95)
PLAUSIBLE = {"PERSON": (0.1, 1.1, 0.1, 2.2), "ROBOT": (0.1, 1.35, 0.08, 1.45)}
CYLINDER = {"PERSON": (0.25, 1.7), "ROBOT": (0.34, 0.8)}

# fixed values: tracking, recovery, identity, evaluation
MAX_AGE_FRAMES, EWMA_KEEP, EWMA_NEW = 10, 0.72, 0.28
ASSOCIATION_LIMIT, ASSOCIATION_DUMMY = 1.15, 1.25
APPEARANCE_LIMIT = 0.48
GT_GATE_M, AB_IOU = 1.5, 0.5

POLICIES = ("LEGACY", "PHYSICAL_DIRECT", "GROUND_LIMITED", "HEIGHT_BANDED", "TEMPORAL_PRIMARY_OCCUPANCY_SECONDARY", "PERSON_CONDITIONAL_PROTECTION")
