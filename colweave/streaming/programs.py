"""Programs over streams: what needs no order or lookup of all rows runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.program import Program
from ..types import TypeMismatch


def on_stream(program: Program, stream: DataFrame) -> DataFrame:
    """The program's rows, or its aggregates (for complete or update mode), as a streaming DataFrame.

    One shape of output at a time, since a streaming query has one sink. Row
    numbers, packing by order, scatter and integer products need all rows and are refused.
    """
    shapes = {e.op if e.op in ("agg", "grouped", "pack", "scatter") else "row" for e in program.outputs.values()}
    if len(shapes) != 1 or shapes & {"scatter"}:
        raise TypeMismatch(f"a stream takes one shape of output, row, agg, grouped or pack, not {sorted(shapes)}")
    result = program.plan(stream)
    (shape,) = shapes
    if shape == "row":
        return result.vectors
    if shape == "agg":
        return result.scalars
    frames = list((result.grouped if shape == "grouped" else result.packed).values())
    if len(frames) != 1:
        raise TypeMismatch(f"a stream takes one {shape} output")
    return frames[0]


def start(program: Program, stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run on a stream into the in-memory table of that name."""
    return on_stream(program, stream).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).start()
