"""Streaming forms of the per-document operators, and the stateful limiter.

The document operators are narrow, so they run on a stream unchanged. The shortlist orders rows across documents and so is made batch by
batch in foreachBatch.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import rules as R


def stream_table(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 4) -> DataFrame:
    """Parquet files arriving in a folder, with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scored_stream(extractions: DataFrame, key: str, text: str, weak: list[str], cliches: list[str]) -> DataFrame:
    """Scores of each arriving extraction: the batch operators on a streaming DataFrame, without state."""
    return R.scores(R.evaluate(R.facts(extractions, key, text, weak, cliches), key), key)


def event_counts(events: DataFrame, time: str, kind: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Events and distinct users by window and type; events later than `late` behind the watermark are dropped."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))


def limited_stream(events: DataFrame, key: str, time: str, tie: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, event, allowed): the fixed-window limiter with a window kept per key.

    A window is forgotten once the watermark, `late` behind the newest event, has passed its end, so a replay decides as the first run did, however fast it goes. Events behind the watermark are dropped.
    """

    def decide(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([time, tie])
        allowed = []
        for t in rows[time]:
            at = int(pd.Timestamp(t).value // 1000)
            if opened is None or at - opened >= seconds * 1_000_000:
                opened, n = at, 0
            n += 1
            allowed.append(n <= limit)
        closes = opened // 1000 + seconds * 1000
        if closes > state.getCurrentWatermarkMs():
            state.update((opened, n))
            state.setTimeoutTimestamp(closes)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [group[0]] * len(rows), tie: rows[tie].to_numpy(), "allowed": allowed})

    picked = events.select(F.col(key).cast("bigint").alias(key), F.col(time).cast("timestamp").alias(time), F.col(tie).cast("bigint").alias(tie)).withWatermark(time, late)
    return picked.groupBy(key).applyInPandasWithState(decide, f"{key} bigint, {tie} bigint, allowed boolean", "opened bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands every micro-batch to `write`; a batch id seen before comes again only after a failure."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
