"""The catalogue of faults."""

#: Type, tier, group that the fault shows in, how it is made.
FAULTS = [
    ("gyro_bias_step", "implemented", "gyro", "Add a constant offset to all gyro axes for a short interval."),
    ("gyro_bias_drift", "implemented", "gyro", "Add a linearly increasing ramp to all gyro axes."),
    ("accel_bias_drift", "implemented", "accel", "Add a linearly increasing ramp to all accel axes."),
    ("accel_freeze", "implemented", "accel", "Hold all accel axes at the value from anomaly onset."),
    ("gyro_freeze", "implemented", "gyro", "Hold all gyro axes at the value from anomaly onset."),
    ("noise_burst", "implemented", "mixed", "Add Gaussian noise to both accel and gyro channels."),
    ("clipping", "implemented-legacy", "accel", "Legacy clipping with inverted severity semantics; preserved for backward compatibility."),
    ("hard_clipping", "implemented", "accel", "Clip accel channels to a bounded range with severity mapped to harsher lower clip bounds."),
    ("packet_dropout", "implemented", "mixed", "Replace live raw IMU samples with stale packet values over a short interval."),
    ("sensor_lag", "implemented", "accel", "Replace accel samples with lagged earlier accel values during active motion."),
    ("timestamp_jitter", "implemented", "mixed", "Warp raw IMU values with a non-uniform time axis to mimic jitter before resampling back."),
    ("cross_axis_leakage", "implemented", "accel", "Leak accel energy across axes to mimic transient cross-axis coupling."),
    ("gyro_accel_inconsistency", "implemented", "accel", "Rotate accel vectors during active motion while leaving gyro unchanged, creating cross-sensor inconsistency."),
    ("impact_pulse", "implemented", "accel", "Add a short Hanning pulse to vertical acceleration."),
    ("vibration_burst", "implemented", "accel", "Add a short sinusoidal burst to vertical acceleration."),
    ("angular_rate_burst", "implemented", "gyro", "Add a short sinusoidal burst to yaw rate."),
    ("accel_bias_step", "planned", "accel", "Add a constant offset to all accel axes for a fixed interval."),
    ("accel_bias_drift", "planned", "accel", "Add a slowly increasing ramp to accel axes."),
    ("gyro_freeze", "planned", "gyro", "Hold all gyro axes constant during motion."),
    ("stuck_at_zero", "planned", "mixed", "Force one or more channels to zero for a sustained interval."),
    ("packet_dropout", "planned", "mixed", "Replace a span with repeated previous values to mimic dropped packets."),
    ("quantization_stair_step", "planned", "mixed", "Reduce channel precision to coarse quantized bins over an interval."),
    ("axis_sign_flip", "planned", "gyro", "Invert one axis sign to mimic a sign convention or wiring fault."),
    ("axis_swap", "planned", "mixed", "Swap two physical axes to mimic miswired or misconfigured channels."),
    ("timestamp_jitter", "planned", "mixed", "Perturb effective sample timing and resample back to fixed rate."),
    ("cross_axis_coupling", "planned", "mixed", "Leak motion from one axis into another to mimic calibration error."),
]
