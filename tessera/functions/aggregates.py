"""The dialect's aggregates as Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = {"MAX": F.max, "MIN": F.min, "SUM": F.sum, "COUNT": F.count, "AVG": F.avg}


def aggregate(function: str, of: Column) -> Column:
    return FUNCTIONS[function](of)
