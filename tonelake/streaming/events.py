"""Windows over event streams. Every function works on a batch table, too, and gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _watermarked(events: DataFrame, at: str, late: str) -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late) if events.isStreaming else rows


def tumbling(events: DataFrame, size: str, by: str, value: str, at: str = "ts", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``(start, by, n, total)`` per tumbling window, or sliding with ``slide``; events later than ``late`` are dropped."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    sums = _watermarked(events, at, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """``(start, end, by, n)``: runs of events without a pause of ``gap``."""
    found = _watermarked(events, at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def once_each(events: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of ``key``; the state is dropped with the watermark."""
    rows = _watermarked(events, at, late)
    return rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


def latest(events: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """The newest state per key; on a stream in update or complete mode, the state is one row per key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_s")).select(key, "_s.*")


def budget_stream(events: DataFrame, key: str, at: str, cost: str, tie: str, capacity: float, refill: float, late: str = "1 hour") -> DataFrame:
    """``(key, at, tie, tokens)`` like :func:`tonelake.plans.ranks.budgets`, from a stream whose batches come in order of time.

    The state of a key is what its budget holds and since when. Once a budget must be full again the watermark drops the
    state: a key that comes back starts full, which is the same. Rows behind the watermark are dropped.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, tie)}
    rows = _watermarked(events.select(key, at, cost, tie), at, late)

    def charge(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, since = state.get if state.exists else (capacity, None)
        pdf = pd.concat([*batches]).sort_values([at, tie])
        seconds, held = pdf[at].astype("datetime64[us]").astype("int64") / 1e6, []
        for now, spent in zip(seconds, pdf[cost]):
            tokens = min(capacity, tokens + (now - since) * refill if since is not None else capacity)
            tokens, since = tokens - (0.0 if pd.isna(spent) else float(spent)), now
            held.append(tokens)
        state.update((tokens, since))
        state.setTimeoutTimestamp(max(int((since + (capacity - tokens) / refill) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pdf[[key, at, tie]].assign(tokens=held)

    schema = f"{key} {kinds[key]}, {at} timestamp, {tie} {kinds[tie]}, tokens double"
    return rows.groupBy(key).applyInPandasWithState(charge, schema, "tokens double, since double", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into Parquet, and return the written table."""
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(path)
        query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
