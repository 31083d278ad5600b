"""Tables staged in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. A staged table cuts the lineage as a checkpoint does,
but is computed once, keeps its columns prunable and survives the loss of any executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset on one machine, a new local one, and on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.depweave.staging", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="depweave-")
        spark.conf.set("spark.depweave.staging", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df under a fresh path of the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for p in paths:
        if "/staged/" in p:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
