"""Table contracts: ordered column lists, feature sets, constants.

Fixed values, shared with the data that the engine reads.
"""

RAW = ["q_x", "q_y", "q_z", "q_w", "ang_vel_x", "ang_vel_y", "ang_vel_z", "lin_acc_x", "lin_acc_y", "lin_acc_z"]
DERIVED = ["gyro_norm", "accel_norm", "angular_accel_norm", "jerk_norm", "gyro_rms_local", "accel_rms_local"]
GT_CONTEXT = ["gt_speed_mps", "gt_horizontal_speed_mps", "gt_vertical_speed_mps", "gt_yaw_rad", "gt_yaw_rate_rps"]
QUATERNION, GYRO, ACCEL = RAW[0:4], RAW[4:7], RAW[7:10]
GROUPS = {"quaternion": QUATERNION, "gyro": GYRO, "accel": ACCEL}
FEATURE_SETS = {"raw": RAW, "raw_plus_derived": RAW + DERIVED}
MODES = ["zscore", "robust"]
GT_POSITION = ["p_w_b_x", "p_w_b_y", "p_w_b_z"]
GT_QUATERNION = ["q_w_b_x", "q_w_b_y", "q_w_b_z", "q_w_b_w"]
SEQUENCE, TIME, STEP = "sequence_name", "timestamp_ns", "timestep_index"

WINDOW, TRAIN_STRIDE, SCORE_STRIDE, RATE_HZ = 150, 50, 5, 50.0
#: Motion context gates: metres a second, metres a second, radians a second.
SPEED_GATE, VERTICAL_GATE, YAW_GATE = 0.263, 0.050, 0.114
ADAPTIVE_ROWS, ADAPTIVE_Z, SCALE_RATIO, LEAST_SCALE = 300, 5.0, 0.05, 1e-6
SEVERITY = {"small": 1.5, "medium": 3.0, "large": 5.0}
