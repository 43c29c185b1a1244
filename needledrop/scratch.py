"""Where jobs keep intermediate tables: the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is named, a new one on one machine, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="needledrop-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, *partitions: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders by ``partitions`` if there are any, and read it back.

    This cuts the lineage, so a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/needledrop/{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
