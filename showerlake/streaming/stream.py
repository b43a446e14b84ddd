"""Compression of streams: sums that grow within windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_merge(stream: DataFrame, *, time: str = "ts", watermark: str = "10 minutes", window: str = "1 hour", origin: bool = True) -> DataFrame:
    """Count, energy and energy-weighted x, y, z and t (those that are there) of each (window, shower, cell).

    Rows later than the watermark go. Rows without a time go from a stream, where no
    watermark would ever close their window; in a batch they have a window without start.
    origin: a group without energy is at the origin; otherwise its means are what they
    come to, 0/0 (NaN), or null where energies or places are unknown.
    """
    w = F.col("e").cast("double")
    at, keys = F.col(time), ["shower_id", "cell_id"]
    start = F.col("w.start")
    if not stream.isStreaming:  # window() itself drops nulls
        at = F.coalesce(at, F.lit("1970-01-01").cast(stream.select(time).schema[0].dataType))
        keys.append(F.col(time).isNotNull().alias("timed"))
        start = F.when(F.col("timed"), start)
    grouped = stream.withWatermark(time, watermark).groupBy(F.window(at, window).alias("w"), *keys)
    places = [c for c in "xyzt" if c in stream.columns]
    out = grouped.agg(F.count("*").alias("n"), F.sum(w).alias("e"), *[F.sum(F.col(c).cast("double") * w).alias(f"s{c}") for c in places])

    def mean(c: str):
        if origin:
            return F.when(F.col("e") > 0, F.col(c) / F.col("e")).otherwise(0.0)
        return F.when(F.col("e") == 0, F.col(c) * float("nan")).otherwise(F.col(c) / F.col("e"))  # null stays null

    return out.select(start.alias("window_start"), "shower_id", "cell_id", "n", "e", *[mean(f"s{c}").alias(c) for c in places])


def compress_batches(stream: DataFrame, algorithm, path: str, *, checkpoint: str, once: bool = False):
    """Each micro-batch of whole showers goes through an algorithm; returns the running query.

    A batch is written to a folder of its number, which a repeated batch (after a
    restart) replaces, so that nothing is written twice. once: only what is there.
    """

    def step(batch: DataFrame, number: int) -> None:
        algorithm.compress(batch).points.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def events_as_deposits(events: DataFrame) -> DataFrame:
    """The driver's events: a shower for each user, a cell for each event type, places by value and hour."""
    cells = {"click": 1, "view": 2, "purchase": 3, "signup": 4, "logout": 5}
    code = F.create_map(*[F.lit(v) for kv in cells.items() for v in kv])
    cell = F.coalesce(F.element_at(code, F.col("event_type")), F.lit(0))
    return events.select("ts", F.col("user_id").alias("shower_id"), cell.cast("bigint").alias("cell_id"), F.abs("value").alias("e"), F.hour("ts").cast("double").alias("x"), F.minute("ts").cast("double").alias("y"), cell.cast("double").alias("z"), F.dayofmonth("ts").cast("double").alias("t"))
