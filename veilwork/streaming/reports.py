"""Fitted masks on streams, class sizes per window with late data, and rows released once their class is large enough."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegralType, StringType, StructField, StructType

from veilwork.core import Mask
from veilwork.errors import InputError


def masked_stream(stream: DataFrame, mask: Mask, output: str = "all") -> DataFrame:
    """The mask's expressions over a stream: what it learned from a batch goes along as literals, no state is kept."""
    return mask.apply(stream, output)


def windowed_classes(stream: DataFrame, time_col: str, keys: Sequence[str], width: str = "1 hour", late: str = "10 minutes", k: int = 5) -> DataFrame:
    """Per window and class of the keys: rows, and whether there are more than k. Null keys make no class."""
    rows = stream.withWatermark(time_col, late).dropna(subset=[time_col, *keys])
    counts = rows.groupBy(F.window(time_col, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "rows", (F.col("rows") > k).alias("is_k_anon"))


def _kept(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _back(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def released_rows(stream: DataFrame, time_col: str, keys: Sequence[str], k: int = 5, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """The stream's rows and ``released``: a row waits until ``k`` rows of its class have come, and leaves with them.

    A class is a value of all ``keys`` within a window of ``seconds``; null is a value. When the watermark passes the end
    of a window, the rows of its classes that still wait leave with null in the keys and ``released`` false, and so does a row
    whose window is over when its class begins. Rows older than the watermark of the batch before drop out, as in every
    query with a watermark. So no row leaves with its keys unless ``k`` rows of its class have been seen, and none leaves twice. A row
    without time has a class that never closes.

    The state of a class is a count and, below ``k``, the rows that wait: ``k - 1`` at most. A class of a third of all rows
    goes through one task, in Arrow batches, and leaves nothing but its count there; spread it by a further key if that
    is too much. State lies in the query's checkpoint, so a restart goes on where the stream was.
    """
    if k < 1 or seconds < 1 or not keys:
        raise InputError("one row, one second and one key or more are needed")
    whole = [f.name for f in stream.schema if isinstance(f.dataType, IntegralType)]  # as text: pandas has no whole numbers with nulls
    inside = StructType([StructField(f.name, StringType() if f.name in whole else f.dataType) for f in stream.schema])
    schema = StructType([*inside.fields, StructField("released", BooleanType())])

    def masked(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(released=False, **{c: None for c in keys})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept = state.get if state.exists else (0, None)
        waiting = [_back(kept)] if kept else []
        if state.hasTimedOut:
            state.remove()
            yield from (masked(w) for w in waiting)
            return
        for rows in frames:
            n += len(rows)
            waiting.append(rows[inside.names])
            if n >= k:
                yield from (w.assign(released=True) for w in waiting)
                waiting = []
        end = key[-1]
        if end is not None and not pd.isna(end) and end <= state.getCurrentWatermarkMs():  # its timer can't be set any more
            if state.exists:
                state.remove()
            yield from (masked(w) for w in waiting)
            return
        state.update((n, _kept(pd.concat(waiting, ignore_index=True)) if waiting else None))
        if end is not None and not pd.isna(end):
            state.setTimeoutTimestamp(int(end))

    end = (F.floor(F.unix_micros(F.col(time_col)) / F.lit(seconds * 1_000_000)) + 1) * (seconds * 1000)
    rows = stream.withWatermark(time_col, late).withColumns({c: F.col(c).cast("string") for c in whole}).withColumn("_end", end.cast("bigint"))
    out = rows.groupBy(*keys, "_end").applyInPandasWithState(step, schema, "n bigint, kept binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in stream.schema if f.name in whole})
