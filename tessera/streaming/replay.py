"""Structured Streaming: replays of recordings, and the motion gate as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream, a few per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def moved_enough(rows: pd.DataFrame, last: tuple[float, float] | None, gate: float) -> tuple[list[bool], tuple[float, float] | None]:
    """Which positions are more than `gate` from the last one that passed; the first passes."""
    keep = []
    for x, y in zip(rows["x"], rows["y"], strict=True):
        ok = last is None or (x - last[0]) ** 2 + (y - last[1]) ** 2 > gate * gate
        keep.append(ok)
        last = (float(x), float(y)) if ok else last
    return keep, last


def motion_gate(stream: DataFrame, key: str, order: str, gate: float = 25.0) -> DataFrame:
    """Positions (key, order, x, y) that moved more than `gate` since the last accepted one, by keyed state over a stream or in a batch."""
    schema = f"{key} bigint, {order} bigint, x double, y double"

    if not stream.isStreaming:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable")
            return pdf[moved_enough(pdf, None, gate)[0]]

        return stream.select(key, order, "x", "y").groupBy(key).applyInPandas(whole, schema)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable")
        keep, last = moved_enough(pdf, state.get if state.exists else None, gate)
        if last is not None:
            state.update(last)
        yield pdf[keep]

    return stream.select(key, order, "x", "y").groupBy(key).applyInPandasWithState(step, schema, "x double, y double", "append", GroupStateTimeout.NoTimeout)


def ready(scans: DataFrame, samples: DataFrame, late: str = "1 minute") -> DataFrame:
    """Scans joined with their samples over two streams: both watermarks bound the state (columns: ts_end, ts_begin; ts)."""
    a, b = scans.withWatermark("ts_end", late).alias("a"), samples.withWatermark("ts", late).alias("b")
    return a.join(b, F.expr("b.ts > a.ts_begin AND b.ts <= a.ts_end"))


def stop_all(spark: SparkSession, wait: int = 60) -> None:
    """Stops every running stream of the session after the batch at hand; a restart goes on from the checkpoint."""
    for q in spark.streams.active:
        q.stop()
        q.awaitTermination(wait)


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes all that is there and stops."""
    df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
