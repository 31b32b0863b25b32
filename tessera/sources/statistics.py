"""What is known of a table's size and values before a query runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError

#: Bytes that a row is taken to have where nothing else is known.
ROW_BYTES = 100


@dataclass(frozen=True)
class TableStats:
    """Rows, and distinct values by column, of those columns that are known."""

    rows: float
    distinct: Mapping[str, int] = field(default_factory=dict)


def parse_stats(text: str, columns: list[str]) -> TableStats:
    """A statistics file: the number of rows, then the distinct values of each column in the table's order."""
    try:
        rows, *distinct = map(int, text.split())
        return TableStats(rows, dict(zip(columns, distinct, strict=True)))
    except ValueError:
        raise QueryError(f"a statistics file needs the rows and {len(columns)} numbers of distinct values") from None


def format_stats(stats: TableStats, columns: list[str]) -> str:
    return f"{stats.rows:.0f}\n" + "\t".join(str(stats.distinct[c]) for c in columns) + "\n"


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's bytes: file sizes, scaled by the columns that are read. No job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def planned(df: DataFrame) -> TableStats:
    """Statistics from the plan alone."""
    return TableStats(max(1.0, plan_bytes(df) / ROW_BYTES))


def gathered(df: DataFrame, exact: bool = False) -> TableStats:
    """Statistics from one pass over the table. Distinct values are estimated by sketches, which combine on the map
    side and take a fixed space for each column; exact ones are counted column by column, as all at once would
    multiply the rows by the columns."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    if not exact:
        found = df.agg(F.count("*"), *[F.approx_count_distinct(c) for c in cols]).first()
        return TableStats(found[0], dict(zip(df.columns, found[1:], strict=True)))
    return TableStats(df.count(), {c: df.agg(F.count_distinct(col)).first()[0] for c, col in zip(df.columns, cols, strict=True)})
