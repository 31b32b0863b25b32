"""Queries of the dialect over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import Engine
from ..errors import QueryError
from ..plans.ast import Aggregate


def start(
    engine: Engine,
    text: str,
    name: str,
    checkpoint: str | None = None,
    watermark: tuple[str, str] | None = None,
    sink: str = "memory",
    path: str | None = None,
    mode: str | None = None,
) -> StreamingQuery:
    """Run a query whose FROM has a streaming table, into a sink: a format that Spark writes streams to, with its path
    if it has one. `memory` keeps the result on the driver as table `name`, for trials.

    Queries without groups append. Aggregates give changed groups (update) where a watermark lets the state end,
    else the complete result, whose state holds every group; into files they need a watermark column among the
    group keys, and append a group when it is over. DISTINCT, and GROUPBY without aggregates, need a watermark
    on a selected column, as their state would grow with the stream. ORDERBY needs the complete result.
    """
    done = engine.analyze(text)
    df: DataFrame = engine.dataframe(text, watermark=watermark)
    if not df.isStreaming:
        raise QueryError("no table in FROM is a stream")
    q = done.query
    aggregated = any(isinstance(x, Aggregate) for x in done.select)
    if q.order_by and (not aggregated or watermark):
        raise QueryError("ORDERBY over a stream needs aggregates and their complete result, so no watermark")
    timed = watermark is not None and any(getattr(x, "name", None) == watermark[0] for x in (q.group_by if aggregated else done.select))
    if (q.distinct or q.group_by) and not aggregated and not timed:
        raise QueryError("distinct rows of a stream need a watermark on a selected column, else their state never ends")
    if aggregated and sink not in ("memory", "console") and not timed:
        raise QueryError(f"aggregates into {sink} need a watermark column among the group keys")
    if mode is None:
        mode = "append" if not aggregated or sink not in ("memory", "console") else "update" if watermark else "complete"
    writer = df.writeStream.format(sink).queryName(name).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return writer.start(path) if path else writer.start()
