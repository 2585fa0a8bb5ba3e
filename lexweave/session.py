"""A session with the settings that the engine counts on, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew splitting; further settings by name."""
    b = SparkSession.builder.appName("lexweave").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, else that of ``spark.checkpoint.dir``.

    Where neither is set, a session in one process (tests) gets a temporary folder; a
    cluster gets an error, as its executors would not see the driver's files.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="lexweave-")
        sc.setCheckpointDir(path)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, which cuts its lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over the cores where the files have fewer parts than there are cores.

    Texts then cost one exchange of an input that is smaller than a part for each core; an input
    with parts enough, which is any large one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if parts < cores else df
