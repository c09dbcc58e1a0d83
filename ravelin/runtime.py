"""What every operator needs from the session: the shared folder, written intermediate tables, size checks before a broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it's known to have at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: Spark's setting to delete an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: set[str] = set()
_local: dict[str, str] = {}


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it lies for the driver, even if it's neither installed nor in the working directory."""
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (here, env.get("PYTHONPATH", ""))))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without that setting gets a folder of its own.

    Raises RuntimeError on a cluster without the setting: a machine-local folder would lose data with its machine.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="ravelin-")
        spark.sparkContext.setCheckpointDir(_local[app])
        atexit.register(shutil.rmtree, _local[app], True)
    return _local[app]


def written(df: DataFrame, name: str = "table", forget: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there and lost executors cost no recomputation.

    The table is deleted when the driver ends. Nothing is cached in executor memory. forget: the shuffle files of df are deleted once it's written,
    instead of when the driver happens to collect its garbage; a df that's used again shuffles again.
    """
    spark = df.sparkSession
    path = passing(spark, name)
    before = spark.conf.get(CLEANUP, None)
    if forget:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if forget:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Deletes written tables that aren't read any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def passing(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, which is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/ravelin-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_forget, spark)
    _written.add(path)
    return path


def _forget(spark: SparkSession) -> None:
    """Deletes the written tables, as far as the session still lives."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _written:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone, and with it the means to delete
        pass
    _written.clear()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows. It reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it's small, else df as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if small(df, rows) else df


def pinned(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df as a local table: for a side that's a set of questions or settings, is computed once and is known to be small from then on.

    Raises ValueError if there are more rows; nothing that grows with a corpus belongs here.
    """
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows; give them in several parts")
    return df.sparkSession.createDataFrame(got, df.schema)
