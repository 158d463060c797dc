"""Session helpers for tests, the bench and the command line.

Library operators take a DataFrame and never touch the session; only entry
points call these helpers.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# The JVM interprets methods of more bytecode than this for good; a stage fused into such a method
# (many derived columns) runs faster operator by operator.
JIT_LIMIT = "8000"
# the folder of each local application without the setting (it cannot be changed once Spark runs)
_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "dayspan", driver_memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench (the UI stays off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small local data: let AQE keep enough post-shuffle tasks for all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, and only when the setting is absent, a fresh folder
    under the system temp dir is taken. On a cluster a machine-local folder
    would give every executor its own copy, so a missing setting is an error.
    Returns the folder in use.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share (master {master})")
        app = spark.sparkContext.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="dayspan-ckpt-")
        path = _local_dirs[app]
    if not spark.sparkContext.getCheckpointDir():  # each call would make a folder
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint folder for a written stage
    table, below a folder of this application; no two runs share one."""
    return os.path.join(_own_tables(spark), f"{name}-{uuid.uuid4().hex}")


def _own_tables(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def drop_stage_tables(spark: SparkSession) -> int:
    """Delete this application's stage tables once their results have been
    written elsewhere; returns how many were removed. Other runs' tables stay."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(_own_tables(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    tables = [s.getPath() for s in fs.listStatus(root)]
    for t in tables:
        fs.delete(t, True)
    return len(tables)


def cluster_conf(shared_folder: str, executors: int = 1000, cores_per_executor: int = 8) -> dict[str, str]:
    """Submit-time settings for a large cluster (≈100 TB of input).

    Not applied by library code; pass them to ``spark-submit --conf`` or the
    session builder. ``shared_folder`` (HDFS or an object store) holds the stage
    tables. Shuffles start wide and AQE coalesces them to ~256 MB
    partitions, splits skewed ones, and turns joins into broadcasts only when
    the measured side is small.
    """
    slots = executors * cores_per_executor
    return {
        CHECKPOINT_CONF: shared_folder,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(slots * 4),
        "spark.sql.shuffle.partitions": str(slots * 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.codegen.hugeMethodLimit": JIT_LIMIT,
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        "spark.shuffle.service.enabled": "true",
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
        "spark.task.maxFailures": "8",
    }
