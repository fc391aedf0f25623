"""Session construction and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tenderlake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the library relies on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    configuration and AQE decide both.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for tables that several steps read.

    It lies in ``spark.checkpoint.dir``, which all executors share, or else in
    ``spark.sql.warehouse.dir``, and is removed when the application ends.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{parent.rstrip('/')}/tenderlake-{spark.sparkContext.applicationId}"
    if folder not in _MADE:
        _MADE.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


_MADE: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    For frames that later steps read several times with different columns (which
    defeats exchange reuse) and for the state of iterations: the lineage ends at
    files that survive a lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that a newer one has replaced; nothing may read it afterwards."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for name in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if folder.rpartition("/")[2] in name:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
