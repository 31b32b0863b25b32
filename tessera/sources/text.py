"""Text tables: read by a schema, written in the result format."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text(spark: SparkSession, path: str, schema: T.StructType, separator: str | None = None) -> DataFrame:
    """Rows of a text table without header. Without separator, values stand between any white space, so none is
    empty or has blanks; with one (a tab, say) they may be and may have. Blank lines are no rows."""
    line = F.col("value")
    if separator is None:
        values = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
    else:
        values = F.split(line, F.lit("\\Q" + separator + "\\E"))
    rows = spark.read.text(path).where(F.length(F.regexp_replace("value", r"\s+", "")) > 0)
    return rows.select(values.alias("v")).select(
        *[F.get("v", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    )


def write_result(df: DataFrame, path: str, titles: Sequence[str] | None = None) -> int:
    """df as one text file on the driver: titles two blanks apart, then rows whose values end in a tab; null is
    -NULL-. Rows stream through the driver a partition at a time. Returns how many there were."""
    count = 0
    with Path(path).open("w", encoding="utf-8") as out:
        out.write("".join(f"{t}  " for t in titles or df.columns) + "\n")
        for row in df.toLocalIterator(prefetchPartitions=True):
            out.write("".join(f"{'-NULL-' if v is None else v}\t" for v in row) + "\n")
            count += 1
    return count


def write_table(df: DataFrame, path: str) -> None:
    """df as a tab-separated text table, written by the executors; read_text(separator='\\t') reads it."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])).write.text(path)
