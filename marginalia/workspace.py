"""Where intermediate tables go: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; where the setting is absent, the warehouse, which a cluster shares too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/marginalia/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the input. Its files, or what is left of them by the share of its columns, can be under the
    threshold of a broadcast while its rows are millions, since repeated and null values take next to nothing there; then it would pass
    whole through the driver."""
    return df.hint("merge")


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote; call it when no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
