"""Pictures and signals as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import images


def metadata_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Header rows of image files as they arrive in a folder."""
    return images.metadata(images.stream_files(spark, path, per_trigger))


def frame_stream(spark: SparkSession, path: str, most_frames: int | None = None, per_trigger: int = 100) -> DataFrame:
    """Decoded pictures as they arrive; ``most_frames`` of each file, as a bounded queue would keep."""
    return images.pixels(images.stream_files(spark, path, per_trigger), most_frames)


def consume(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every micro-batch of what is there now to ``each``."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows of each key and time window; what comes later than ``late`` is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def running_differences(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Differences from the value before, per key across micro-batches (its last value is state)."""

    def step(keys: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(order, kind="stable")
        before = state.get[0] if state.exists else 0
        values = data[value].astype("int64")
        state.update((int(values.iloc[-1]),))
        yield pd.DataFrame({key: keys[0], order: data[order].to_numpy(), "diff": values.diff().fillna(values.iloc[0] - before).astype("int64").to_numpy()})

    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind[key]}, `{order}` {kind[order]}, diff bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
