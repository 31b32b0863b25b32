"""Small files wherever Spark's file systems reach: descriptions, statistics, query texts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def read_small(spark: SparkSession, path: str) -> str:
    """The whole text of a file that the driver can hold."""
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    fs, place = _at(spark, path)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
