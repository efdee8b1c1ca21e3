"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Paths below the shared folder that this process has handed out, with the session that can delete them.
_HANDED_OUT: dict[str, SparkSession] = {}


def build_session(app: str = "panelspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; on a cluster ``master`` comes from spark-submit.

    Call-site tracking of Column operations is off: the statistics build thousands of
    them, and tracking costs several round trips to the JVM for each.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers started from here on find this package where the driver found it.

    A worker doesn't see additions to the driver's path. On a cluster the package is shipped with the job; a folder that isn't there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="panelspark-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; deleted by ``discard``, or when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _HANDED_OUT[path] = spark
    return path


def discard(*paths: str) -> None:
    """Delete scratch paths that nothing reads any more; paths that ``scratch_path`` didn't give are left alone."""
    for path in paths:
        spark = _HANDED_OUT.pop(path, None)
        if spark is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _discard_all() -> None:
    try:
        discard(*list(_HANDED_OUT))
    except Exception:  # noqa: BLE001 - the JVM may have ended before
        pass


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that outlives executors."""
    return materialise_at(scratch_path(df.sparkSession, name), df, partition_by)


def materialise_at(path: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """``materialise`` to a path that the caller may ``discard`` later."""
    df.write.mode("errorifexists").parquet(path, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)
