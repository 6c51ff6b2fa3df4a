"""Session settings the jobs rely on, and the shared folder they may write to."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Joins carry no broadcast hint unless the side is one row or a bounded literal table: the adaptive
    # planner broadcasts what turned out small and splits hot partitions of what did not.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "signalspark") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folders: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``), which driver and executors share.

    Without that setting only a session in one process gets a folder of its own, deleted when the process ends;
    on a cluster a machine-local folder would lose rows, so this raises.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        folder = tempfile.mkdtemp(prefix="signalspark-")
        _own_folders[context.applicationId] = folder
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + _own_folders[context.applicationId]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``shared_root``."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Later stages then start from files, which outlive an executor, and the planner knows the true size: a
    small side is broadcast because it is measured to be small.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
