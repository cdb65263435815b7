"""Stateful streams: a bounded cache of keys and values for each layer, and running counts of event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "layer long, position long, length long, accepted boolean"


def kv_cache(stream: DataFrame, capacity: int) -> DataFrame:
    """Appends rows (layer, position) to each layer's cache in order of position; rows beyond the capacity are refused.

    State is one number a layer: the cache's rows themselves go to the sink.
    """

    def append(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values("position")
        out = []
        for position in rows["position"]:
            fits = held < capacity
            held += fits
            out.append((int(key[0]), int(position), int(held), bool(fits)))
        state.update((int(held),))
        yield pd.DataFrame(out, columns=["layer", "position", "length", "accepted"])

    return stream.groupBy("layer").applyInPandasWithState(append, _OUT, "held long", "append", "NoTimeout")


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of event values by type in tumbling windows of `ts`; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
