"""Operators that a training-data pipeline needs, beside the telemetry engine.

Nothing outside this subpackage imports it.  Operators take DataFrames and
return DataFrames; what they have to materialise on the way goes to the shared
folder named by ``spark.checkpoint.dir`` (see :mod:`kinetrace.llm.common`).
"""
