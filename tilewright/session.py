"""Session helper and table loading shared by all operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "tilewright") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session and settings."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TILEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder that is set, or the cluster's ``spark.checkpoint.dir``.

    Only a session in one process, as in tests, has a default, below ``/tmp/checkpoints``; on a cluster each
    machine would write to its own disk there, so a session without a folder is an error.
    """
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get().rsplit("/", 1)[0]  # Spark adds a folder of its own
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints/tilewright"


#: With this setting Spark deletes a query's shuffle files when its action ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder (see ``shared_folder``).

    What the step has shuffled is deleted when its rows are written: nothing reads it again, as the checkpoint takes
    the place of the plan. Up to then the files stay, so a lost executor only costs its own tasks.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        # The setting holds for queries that are made under it, hence the select.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEAN, before)
