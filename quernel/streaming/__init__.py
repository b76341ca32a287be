"""Requests over streams.

The model has no streaming notions and needs none: a registered table may be a streaming
DataFrame.  Single-branch requests aggregate it in Structured Streaming's complete mode, where
the final sort is allowed too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..errors import InvalidQuery


def stream(engine: Engine, request: dict, table: str, checkpoint: str | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """The request over streaming facts.

    ``sink`` gets every whole result with its number and writes it where it likes.  Without one
    it is kept in memory table ``table`` on the driver, which suits results as small as reports are.
    """
    if engine.plan(request).combine != "single":
        raise InvalidQuery("only requests of one branch run over streams")
    df: DataFrame = engine.query(request)
    if not df.isStreaming:
        raise InvalidQuery("no table of the request is a stream")
    writer = df.writeStream.outputMode("complete").queryName(table)
    writer = writer.foreachBatch(sink) if sink else writer.format("memory")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
