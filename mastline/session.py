"""Session builder and the few settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

ENGINE_CONF = {
    # Telemetry timestamps carry a literal Z, so wall-clock time is UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans see the row counts that catalog tables keep.
    "spark.sql.cbo.planStats.enabled": "true",
}


def build_session(app_name: str = "mastline", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults; ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the cluster's shared folder.

    A session that names none gets a folder in its warehouse, which driver and
    executors share too; a machine-local temporary folder is never used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
