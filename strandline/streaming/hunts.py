"""Queries that arrive as a stream are answered one micro-batch after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.config import HuntOptions
from ..plans.hunt import hunt


def hunt_stream(genome: DataFrame, queries: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, o: HuntOptions = HuntOptions()) -> StreamingQuery:
    """queries: a streaming DataFrame (query_id, name, seq); write(hits, batch) stores each batch's hits."""

    def batch(rows: DataFrame, number: int) -> None:
        write(hunt(genome, rows, o)[0], number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
