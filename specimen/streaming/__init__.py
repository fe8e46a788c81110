"""Row-local operators on streams.

Inspection, cleaning, prose scores, diffs, timestamps, patterns and cell classes look at one row at a time, so they run on a
streaming DataFrame as they are.  What looks at a whole column (table profiles, shapes) runs on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cells import classified
from ..operators import profile


def cell_classes(stream: DataFrame, raw_col: str) -> DataFrame:
    """The class of a cell of each arriving row."""
    return classified(stream.withColumn("raw", F.col(raw_col)))


def windowed_classes(stream: DataFrame, raw_col: str, time_col: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts of cell classes per time window; rows later than ``late`` are left out and their state is dropped."""
    narrow = stream.select(F.col(time_col).alias("event_time"), F.col(raw_col).alias("raw"))
    rows = classified(narrow.withWatermark("event_time", late))
    return rows.groupBy(F.window("event_time", window), "class").agg(F.count(F.lit(1)).alias("n"))


def profile_batches(stream: DataFrame, names: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A column profile of each micro-batch, handed to ``sink(profile, batch number)``."""

    def each(batch: DataFrame, k: int) -> None:
        sink(profile.columns(profile.frequencies(profile.to_cells(batch, names))), k)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
