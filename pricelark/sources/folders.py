"""Folders of partitioned tables by name: listed, moved and dropped through Hadoop's file system."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from pricelark.session import ensure_checkpoint_dir, shuffles_dropped

NULL = "__HIVE_DEFAULT_PARTITION__"
DONE = "_SUCCESS"


def _at(spark: SparkSession, path: str):
    """The file system and its own form of a path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it is not there. Only this level is listed."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory())


def values(spark: SparkSession, path: str, column: str) -> dict[str | None, str]:
    """Value of a partition column -> name of its folder."""
    found = [n for n in names(spark, path) if n.startswith(column + "=")]
    said = {n: unquote(n[len(column) + 1 :]) for n in found}
    return {None if v == NULL else v: n for n, v in said.items()}


def drop(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table beside the checkpoints, and its place, for ``drop``. The shuffle files that
    made it are gone."""
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).format("parquet").load(place), place


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, place = _at(spark, path)
    if not fs.rename(place, _at(spark, to)[1]):
        raise OSError(f"cannot move {path} to {to}")
