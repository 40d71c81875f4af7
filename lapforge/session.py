"""Session construction and the shared scratch area."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lapforge", cpus: str | int = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "12g") -> SparkSession:
    """Local session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_ROOTS: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a session in one process may do without it: it gets a temporary folder that is removed at the end. On a
    cluster a local folder would lose what other machines write, so the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    require_shared_folder(spark.sparkContext.master)
    if not _LOCAL_ROOTS:
        _LOCAL_ROOTS.append(tempfile.mkdtemp(prefix="lapforge-"))
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[0], ignore_errors=True)
    return _LOCAL_ROOTS[0]


def require_shared_folder(master: str) -> None:
    """Raise unless the master runs all tasks in the driver's process."""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def run_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    return f"{scratch_root(spark).rstrip('/')}/lapforge-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result that reads them is needed."""
    delete_path(spark, run_folder(spark))


def delete_path(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write an intermediate table below the shared scratch folder and read it back.

    The table survives the loss of any executor, and unlike an RDD checkpoint it can be read column
    by column and has a known size, which the join planning of the next step needs.
    """
    return store(df, label)[0]


def store(df: DataFrame, label: str = "stage") -> tuple[DataFrame, str]:
    """What ``cut_lineage`` gives, and its path, which a job may delete once nothing reads it.

    Nothing reads the shuffles of the finished job, so their files go at once instead of at the driver's next collection.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path
