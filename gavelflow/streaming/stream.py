"""Streams: flood rates, a rate limiter, micro-batch decisions, idempotent sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Allowed calls, in seconds; how many earlier messages count; the largest payload, and tries.
LIMIT, WINDOW = 120, 60
HISTORY, MEMORY_S = 20, 600
MOST_PAYLOAD, MOST_ATTEMPTS = 65_536, 3
#: How late a row of a stream may be; state goes once the watermark has passed what it remembers.
LATE = "10 minutes"


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the files of a folder, so many a micro-batch, or of one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def allowed(stamps: list[float], kept: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """A sliding log: a call passes while fewer than limit calls that passed are in the window before it."""
    out = []
    for t in stamps:
        kept = [x for x in kept if x > t - window]
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out, kept


def limit_rate(events: DataFrame, key: str, ts: str, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """(key, ts, allowed) for each call of a batch table or a stream. Only calls that pass are remembered, so
    the decision feeds the state and no window frame can say it. A batch key's calls are worked on
    in order within its group; a stream keeps the log of a key, at most limit stamps, as state."""
    schema = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField(ts, T.TimestampType()), T.StructField("allowed", T.BooleanType())])
    cols = events.select(key, ts)

    def decide(pdf: pd.DataFrame, kept: list[float]) -> tuple[pd.DataFrame, list[float]]:
        pdf = pdf.sort_values(ts, kind="stable")
        ok, kept = allowed([x.timestamp() for x in pdf[ts]], kept, limit, window)
        return pdf.assign(allowed=ok), kept

    if not events.isStreaming:
        return cols.groupBy(key).applyInPandas(lambda pdf: decide(pdf, [])[0][[key, ts, "allowed"]], schema)

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        out, kept = decide(pd.concat(list(parts)), kept)
        state.update((kept,))
        state.setTimeoutTimestamp(int(out[ts].max().timestamp() * 1000) + window * 1000)
        yield out[[key, ts, "allowed"]]

    return cols.withWatermark(ts, LATE).groupBy(key).applyInPandasWithState(update, schema, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def flood_rates(events: DataFrame, key: str, ts: str, text: str) -> DataFrame:
    """(key, ts, messages_10s, messages_60s, messages_10m, repeated_10m) of a stream: its state is each key's
    last messages, HISTORY at most and none older than ten minutes."""
    schema = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField(ts, T.TimestampType()), *[T.StructField(c, T.LongType()) for c in ("messages_10s", "messages_60s", "messages_10m", "repeated_10m")]])

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = [tuple(json.loads(x)) for x in state.get[0]] if state.exists else []
        rows = []
        for r in pd.concat(list(parts)).sort_values(ts, kind="stable").itertuples(index=False):
            at, body = getattr(r, ts), getattr(r, text)
            now = at.timestamp()
            ages = [now - t for t, _ in past]
            rows.append((k[0], at, *(sum(0 <= a <= s for a in ages) for s in (10, 60, 600)), sum(0 <= a <= 600 and h == body for a, (_, h) in zip(ages, past, strict=True))))
            past = [(t, h) for t, h in [*past, (now, body)] if now - t <= MEMORY_S][-HISTORY:]
        state.update(([json.dumps(x) for x in past],))
        state.setTimeoutTimestamp(int(rows[-1][1].timestamp() * 1000) + MEMORY_S * 1000)
        yield pd.DataFrame(rows, columns=schema.names)

    return events.select(key, ts, text).withWatermark(ts, LATE).groupBy(key).applyInPandasWithState(update, schema, "past array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, key: str, ts: str, late: str = "10 minutes", size: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Counts in sliding windows, which close once the watermark has passed them."""
    w = F.window(ts, size, slide).alias("w")
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, dead: str | None = None, seconds: float = 0.05) -> StreamingQuery:
    """Each micro-batch through a batch pipeline, appended under its number: a batch that is delivered again
    replaces its own folder, so nothing counts twice. Rows whose payload is too large go to dead."""

    def each(batch: DataFrame, number: int) -> None:
        good = batch
        if dead is not None:
            size = F.octet_length(F.to_json(F.struct(*batch.columns)))
            batch.where(size > MOST_PAYLOAD).write.mode("overwrite").parquet(f"{dead}/batch={number}")
            good = batch.where(size <= MOST_PAYLOAD)
        work(good).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def routed(tasks: DataFrame) -> DataFrame:
    """Adds route to queue tasks (payload, attempts): dead for too large a payload or too many tries."""
    return tasks.withColumn("route", F.when(F.octet_length("payload") > MOST_PAYLOAD, "dead").when(F.col("attempts") >= MOST_ATTEMPTS, "dead").otherwise("work"))
