"""Session helpers: test sessions, table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("citeloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, read with column pruning and filter pushdown left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names it.

    Only a session on one machine without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = os.path.join(tempfile.gettempdir(), f"citeloom-{os.getpid()}")
    sc.setCheckpointDir(own)
    return own


_WRITTEN: list[str] = []


@atexit.register
def _remove_written() -> None:
    """Remove the tables that cut() wrote, while the session that can reach their folder still runs."""
    spark = SparkSession.getActiveSession()
    if spark is None or not _WRITTEN:
        return
    try:
        jvm = spark.sparkContext._jvm
        for path in _WRITTEN:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def forget_at_exit(path: str) -> None:
    """Have a folder removed when the program ends."""
    _WRITTEN.append(path)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a compressed table in the shared folder and go on from there.

    Lineage stays short, lost executors cost a read, and the planner knows the table's size. Tables go when the program ends.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, key: tuple, make):
    """What `make` gives (a table, which is written, or an object that holds such tables), made once per application and key.

    For results that several queries start from, as an index or raw scores; changed input calls for another session.
    """
    k = (spark.sparkContext.applicationId, *key)
    if k not in _KEPT:
        got = make()
        _KEPT[k] = cut(got) if isinstance(got, DataFrame) else got
    return _KEPT[k]
