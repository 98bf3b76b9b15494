"""Tables of a data folder, and tables written between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; elsewhere that
    folder would not be shared, so it is an error.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factorloom-shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose last reader is done."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, at = _file(df.sparkSession, folder)
            fs.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read by several later steps, safe against lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, columns: list[str]) -> tuple[list[Column], list[T.StructField]]:
    """Columns under names that clash with nothing, for a trip through Python, and their fields.

    The result gets its names back with ``toDF``.
    """
    cols = [df[f"`{c}`"].alias(f"c{i}_") for i, c in enumerate(columns)]
    return cols, [T.StructField(f"c{i}_", df.schema[c].dataType) for i, c in enumerate(columns)]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    while name in df.columns:
        name += "_"
    return name
