"""Schemas of the run log and the JSON reports."""

from __future__ import annotations

from pyspark.sql import types as T

#: The run log's columns in file order.
RUN_COLUMNS = (
    "run_id", "timestamp_utc", "git_commit_hash", "git_branch", "config_path", "config_hash", "circuit_hash", "task_seed", "reservoir_seed", "python_version", "backend_device",
    "entanglement_metric", "success", "failure_reason", "artifact_paths", "package_versions", "platform", "cli_command", "task_name", "primary_metric_name", "primary_metric_value", "runtime_per_stage_seconds",
)
_KINDS = {"task_seed": T.LongType(), "reservoir_seed": T.LongType(), "entanglement_metric": T.DoubleType()}
#: As text on disk: success and metric values come in several encodings, JSON cells are text.
RUNS = T.StructType([T.StructField(c, _KINDS.get(c, T.StringType())) for c in RUN_COLUMNS])
JSON_CELLS = {"artifact_paths": "array<string>", "package_versions": "map<string,string>", "runtime_per_stage_seconds": "map<string,double>"}
HEALTH = "overall string, timestamp_utc string, checks map<string,string>"
GATE_RESULT = "gate string, result string, evidence map<string,string>, run_ids array<string>, timestamp_utc string"
