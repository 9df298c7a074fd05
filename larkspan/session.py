"""Sessions with the settings that the engine's semantics rest on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Integer overflow raises in `ansi`; in `wrapping` it wraps around.
PROFILES = {"ansi": "true", "wrapping": "false"}


def submitted() -> bool:
    """Whether spark-submit, or its arguments in the environment, name the master."""
    return "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")


def build_session(profile: str = "ansi", master: str | None = None, app: str = "larkspan", events: str | None = None, **conf: str) -> SparkSession:
    """`events` is a folder for the event log, from which Spark's history server shows what ran when.

    `master` is left to spark-submit on a cluster; without either, all local cores are used.

    Shuffle partitions are left to the cluster's settings and to adaptive execution, which coalesces small
    partitions and splits skewed ones; a local session starts from its number of cores.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; there are {', '.join(PROFILES)}")
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.ansi.enabled": PROFILES[profile],
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master or not submitted():
        builder = builder.master(master or "local[*]")
        settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
    if events:
        settings |= {"spark.eventLog.enabled": "true", "spark.eventLog.dir": events}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset, a temporary one if all runs on this machine."""
    global _own_folder
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _own_folder = _own_folder or "file://" + tempfile.mkdtemp(prefix="larkspan-")
    return _own_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/larkspan-{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of new_path() through Spark's own file systems."""
    at, files = _file_system(spark, path)
    files.delete(at, True)
    files.cancelDeleteOnExit(at)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Leaves a folder that has been written to its file system, which deletes it when the driver's JVM ends, session or no session."""
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)
