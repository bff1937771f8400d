"""A Spark-native analytics engine for robot and sensor telemetry."""
