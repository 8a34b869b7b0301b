"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "waymark", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark.

    On a cluster the caller brings its own session; nothing in the library
    creates one or changes its settings.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is only ever used when the session itself runs on
    one machine; on a cluster without the setting this fails instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="waymark-")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run of one job."""
    return f"{shared_base(spark)}/waymark/{label}-{uuid.uuid4().hex}"
