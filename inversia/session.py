"""Session defaults for tests and the bench, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "inversia", cores: str = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """Local session with the settings the operators are designed for (UTC, ANSI, AQE).

    ``checkpoint_dir``: the folder for intermediate tables, by default a new temporary one, which
    is right for one machine only."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="inversia-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # very wide projections outgrow the JIT's method limit; Spark then plans them without fusing
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A plain local session that names none gets a temporary folder; any other must name it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="inversia-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/inversia-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the run folder; nothing is overwritten."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_run(spark: SparkSession) -> None:
    """Remove the run folder. For whoever owns the application, once no table of it is read again:
    results that operators return still read their intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back: later steps and repeated actions
    read columns instead of computing the table again, and an executor lost on the way costs
    nothing. Used where a job goes over an expensive table several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def dropped(table: DataFrame) -> None:
    """Remove what ``staged`` wrote for this very table, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
