"""Session helpers. The session is always passed in; nothing here creates one implicitly."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strata") -> SparkSession:
    """Session for tests and the local bench (UI off, AQE on, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once per application: functions that run
    in tasks are imported there by name."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="strata-", suffix=".zip")  # served by the driver, read by no executor directly
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names (``spark.checkpoint.dir``). Only a session in
    local mode that names none gets a scratch folder; on a cluster that is an error, because executors
    on other hosts could not read a folder of the driver."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="strata-ckpt-")
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "strata-tables", name)


def materialize(df):
    """Cut lineage by writing the frame to the shared checkpoint folder (reliable
    checkpoint, survives executor loss). Used before iterative work such as model fits."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that a task of a model fit should read at most.
TASK_ROWS = 25_000


def dealt(df, least: int = 1):
    """``materialize`` for frames that many passes read. The parts of a checkpoint are those that the plan before it ends
    with: splits of a small file below a broadcast join, or shuffle parts that AQE put together by bytes. All later passes
    have no more tasks than that, so rows are dealt evenly over more parts if there are over ``TASK_ROWS`` a part, or fewer
    than ``least`` parts."""
    df = materialize(df)
    parts = max(least, math.ceil(df.count() / TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= parts else materialize(df.repartition(parts))


#: Rows of a model fit that make a task of their own worthwhile.
FIT_ROWS = 50_000


def gathered(df):
    """A materialized frame for the many short passes of a model fit. A pass over a few thousand rows is all task launch and
    sending sums, so parts are put together, without a shuffle, until there are ``FIT_ROWS`` a part, but not below two
    parts a core: the tasks of a pass follow the rows, not the shuffle parts of the plan before. Parts of over twice as
    many rows are dealt over more."""
    rows, have = df.count(), df.rdd.getNumPartitions()
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / FIT_ROWS))
    if rows > 2 * FIT_ROWS * have:
        return materialize(df.repartition(parts))
    return df.coalesce(parts) if have > parts else df
