"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sheafwork") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SHEAFWORK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where the session has none and runs in one process.

    A cluster without ``spark.checkpoint.dir`` is an error: a folder of one machine would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(os.environ.get("TMPDIR", "/tmp"), "sheafwork-checkpoints")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, so that a lost executor costs no recomputation.

    Written as a compressed table, which is a fraction of what ``checkpoint()`` writes. The tables of a session are
    removed when it ends.
    """
    spark = df.sparkSession
    at = os.path.join(ensure_checkpoint_dir(spark), f"tables-{spark.sparkContext.applicationId}", uuid.uuid4().hex)
    df.write.parquet(at)
    _forget_at_end(spark, os.path.dirname(at))
    return spark.read.schema(df.schema).parquet(at)


_known: set[str] = set()


def _forget_at_end(spark: SparkSession, folder: str) -> None:
    if folder in _known:
        return
    _known.add(folder)

    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone already; the folder's owner clears it
            pass

    atexit.register(drop)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` over at least ``per_core`` partitions a core, for stages that spend far more CPU than they move bytes.

    A scan that already has enough partitions is left alone, so at scale nothing is shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
