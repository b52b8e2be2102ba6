"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"


def build_session(app: str = "creditloom", master: str | None = None,
                  shuffle_width: int | None = None, **conf: str) -> SparkSession:
    """Session for the jobs in this package.

    Partition counts are left to adaptive execution: it starts every exchange
    with ``shuffle_width`` partitions, coalesces what turns out small and
    splits skewed join partitions. Choose the width for the largest exchange,
    about its bytes over 200 MB. On a cluster ``master`` and memory come from
    spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording a Python call site per expression slows building wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_width:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                                 str(shuffle_width))
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="creditloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared scratch folder.

    The folder named by ``spark.checkpoint.dir`` is used wherever the cluster
    sets it. Without it a local folder is only acceptable for a local master,
    where driver and executors are one process; it is removed when the driver ends.
    """
    root = spark.conf.get(SCRATCH_CONF, None)
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {SCRATCH_CONF} to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def default_parallelism() -> str:
    return os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
