"""Ingest of trajectories as a stream: each new trajectory gets its cell and signature without state.

Assignment looks at one trajectory at a time, so the batch expressions hold for a stream as they are.  Pruning and orders stay batch jobs over what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wayquad.functions.geometry import Grid
from wayquad.operators import index


def assign_stream(trajectories: DataFrame, grid: Grid) -> DataFrame:
    """Cells and signatures of a stream of (tid, points)."""
    return index.signed(index.assign(trajectories, grid), grid)


def start(trajectories: DataFrame, grid: Grid, path: str, checkpoint: str) -> StreamingQuery:
    """Append the assigned trajectories to Parquet files under ``path``, once through what there is."""
    writer = assign_stream(trajectories, grid).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
