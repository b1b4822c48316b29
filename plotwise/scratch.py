"""Tables written to the folder that the driver and all executors share.

Writing a table and reading it back cuts the lineage: a lost executor costs a re-read, not a recomputation, and the
planner sees real file sizes instead of guesses.
"""

from __future__ import annotations

import getpass
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temp folder of this machine only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.gettempdir()}/plotwise-{getpass.getuser()}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plotwise/{uuid.uuid4().hex}/{name}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back with the schema it had."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`write_table` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).split("://")[-1].lstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"{root}/plotwise/" in folder:
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
