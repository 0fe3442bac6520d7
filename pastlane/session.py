"""Session settings and the shared folder of the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings that every query relies on. The number of shuffle partitions is not
# here: it belongs to the cluster, and AQE coalesces what is too fine.
QUERY_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # State of a stream beyond the memory of an executor.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Streams here put out changes, never closed windows, so a micro-batch without
    # data would have nothing to say.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def local_session(
    cores: int | str = "*", partitions: int = 8, memory: str = "8g", scratch: str | None = None
) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own.

    ``scratch`` is the folder for checkpoints and tables in between; who gives it removes it.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pastlane")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        # No call sites on every column: they cost more than a small query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Spark deals the cores to tasks; numpy is to use one each.
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
    )
    for name, value in QUERY_SETTINGS.items():
        builder = builder.config(name, value)
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> SparkSession:
    """Gives this package to the Python workers of a session, once, wherever the driver was started.

    The file is made on the driver, and Spark serves it to executors.
    """
    context, name = spark.sparkContext, f"{__package__}.zip"
    if any(path.endswith(f"/{name}") for path in context.listFiles):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="package-")  # read by the driver alone, which serves it
    with zipfile.ZipFile(os.path.join(folder, name), "w") as packed:
        for at, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(at, file)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(os.path.join(folder, name))
    return spark


def use_query_settings(spark: SparkSession) -> SparkSession:
    """Settings that the session's owner has not chosen, and the package; what is chosen stays."""
    ship_package(spark)
    chosen = spark.conf.getAll
    for name, value in QUERY_SETTINGS.items():
        if name not in chosen:
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or else one in the warehouse.

    The same on every master, and nothing of the session is changed. Tables in between stay
    there until the folder's owner clears it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pastlane"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path for one run of ``name`` under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
