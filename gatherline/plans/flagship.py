"""The flagship query: lag targets, cosine features, a ridge readout and memory capacity for every series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatherline.plans import benchmark, workloads


def memory_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.run_task(workloads.series(spark, sf_dir), "stm")
