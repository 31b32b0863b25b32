"""Random tables after a schema description: the same rows for the same seed, made by the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .files import read_small, write_small
from .schema import TableSpec, parse_spec
from .statistics import TableStats, format_stats, gathered
from .text import write_table


def _draw(seed: int, salt: object) -> Column:
    """A number from 0 to 2^63 - 1 that hangs on the row's number, the seed and the salt alone."""
    return F.xxhash64("id", F.lit(seed), F.lit(str(salt))).bitwiseAND(F.lit((1 << 63) - 1))


def _letter(seed: int, salt: str) -> Callable[[Column], Column]:
    return lambda i: F.char(F.lit(97) + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt), i), F.lit(26)))


def _permuted(seed: int, salt: str, n: int) -> Column:
    """Row numbers below n dealt to distinct numbers below n: an affine step modulo n, whose factor shares no divisor
    with n, so it can be undone."""
    step = next(s for s in range(n // 2 + 1 + abs(hash_of(salt, seed)) % max(1, n // 3), 2 * n + 3) if _coprime(s, n))
    return F.pmod(F.col("id") * F.lit(step) + F.lit(abs(hash_of(salt, seed + 1)) % n), F.lit(n))


def hash_of(salt: str, seed: int) -> int:
    value = seed * 2654435761 + 97
    for c in salt:
        value = (value * 31 + ord(c)) % (1 << 61)
    return value


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def generate(spark: SparkSession, spec: TableSpec, rows: int, seed: int = 0) -> DataFrame:
    """rows of a table. INTEGER and REAL are drawn from 0 up to the column's range, a primary key without
    repeats; STRING has as many lower-case letters as the range says."""
    out = []
    for c in spec.columns:
        if c.key == "PK" and c.kind == "INTEGER":
            if rows > c.range:
                raise QueryError(f"{rows} rows need more than the {c.range} values of the key {c.name}")
            value = _permuted(seed, c.name, c.range)
        elif c.kind == "INTEGER":
            value = F.pmod(_draw(seed, c.name), F.lit(c.range))
        elif c.kind == "REAL":
            value = _draw(seed, c.name).cast("double") / F.lit(float(1 << 63)) * F.lit(c.range)
        else:
            value = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(c.range)), _letter(seed, c.name)), "")
        out.append(value.cast(spec.struct[c.name].dataType).alias(c.name))
    return spark.range(rows).select(*out)


def generate_table(spark: SparkSession, folder: str, name: str, rows: int, seed: int = 0) -> TableStats:
    """Text table folder/<name>.txt of random rows after folder/<name>.det, and its statistics in folder/<name>.stat."""
    spec = parse_spec(read_small(spark, f"{folder}/{name}.det"))
    made = generate(spark, spec, rows, seed)
    write_table(made, f"{folder}/{name}.txt")
    stats = gathered(made, exact=True)
    write_small(spark, f"{folder}/{name}.stat", format_stats(stats, made.columns))
    return stats


def statistics(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and distinct values of each column, counted exactly."""
    found = gathered(df, exact=True)
    return found.rows, dict(found.distinct)


def is_key(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return not isinstance(kind, T.NullType) and df.groupBy(F.col(f"`{column}`")).count().where("count > 1").isEmpty()
