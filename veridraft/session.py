"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

#: SQL settings that can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffled rows are small beside the sort buffers of a stage that chains windows and joins: a
    # task that reads 10 MB can hold 2 GB. So tasks stay small however much data there is.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stream state on disk: one row per open audit or session does not fit the executors' heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Session windows: merge inside the map task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", work: str | None = None
) -> SparkSession:
    """A local session for tests and the benchmark; ``work`` is the folder for written tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veridraft")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if work:
        builder = builder.config("spark.checkpoint.dir", work)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders given out and not yet cleaned up.
_WRITTEN: list[str] = []


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for a written table or a stream checkpoint.

    It lies under the shared folder named by ``spark.checkpoint.dir``; only where
    that is unset (tests on one machine) a temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clean_up(spark: SparkSession, paths: list[str] | None = None, but: DataFrame | None = None) -> None:
    """Delete folders that ``work_dir`` has given out (default: all), once their results are no
    longer read. Those that ``but`` reads stay, and stay in ``paths``."""
    paths = _WRITTEN if paths is None else paths
    read = [urlsplit(f).path for f in but.inputFiles()] if but is not None and paths else []
    for name in list(paths):
        below = urlsplit(name).path + "/"
        if any(f.startswith(below) for f in read):
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        paths.remove(name)
        if name in _WRITTEN:
            _WRITTEN.remove(name)


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Add the folders given out inside the block to ``paths``."""
    before = set(_WRITTEN)
    yield
    paths += [p for p in _WRITTEN if p not in before]


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several branches of a plan read, and read it back.

    Cuts the lineage through the shared folder, so a lost executor costs nothing.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
