"""Helpers shared by the operators: session settings, shared tables, words, hashes, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, and a batch stands in memory as a whole.
ARROW_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session of one machine (tests) gets a folder of its
    own; a cluster's raises, as its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of written_table(), if it is still there."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session can be gone by the end of the program
        return


def written_table(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and reread: lineage ends here, and a lost executor
    costs no recomputation. The files go when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(drop_table, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, whichever no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: str | None) -> list[bytes]:
    """Runs of `[^\\x20\\x09-\\x0D]+`: the white space of bytes.split() is exactly that set."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits each depend on all input bits."""
    x = np.asarray(x, dtype=np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b: long): rows (id, component) for each id in a link, where
    component is the smallest id that can be reached.

    Alternates two star rewrites, each one aggregation and one join: every node's larger neighbours
    are tied to its smallest neighbour, then every node's smaller ones are. The number of rounds grows
    with the logarithm of the longest chain; each round is written to the shared folder, so nothing
    of it stands on the driver. No links give no rows. Raises if max_rounds rounds don't settle it, which chains
    of fewer than 2^max_rounds links do.
    """
    edges = written_table(links.select("a", "b").where("a != b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # larger neighbours to the smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = (
            both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        down = up.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        # smaller neighbours and the node itself to the smallest of them
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        tied = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        after_df = written_table(tied.where("a != b").distinct(), "links")
        after = after_df.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        edges = after_df
        if before == tuple(after):
            break
        before = tuple(after)
    else:
        raise RuntimeError("components did not settle")
    ids = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return ids.union(roots)
