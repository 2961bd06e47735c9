"""Structured Streaming jobs over an events source (event_id, user_id, ts, event_type, value).

Each takes a streaming DataFrame and gives one; :func:`run_available` drains a
source once into a table in the shared folder and returns it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    d = stream.parquet(_glob(sf_dir))
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def _glob(sf_dir: str) -> str:
    """A pattern that matches the table whether it is one file or a folder."""
    return f"{sf_dir}/events.parque[t]"


def daily_sum(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Sum of values per type and day; a day closes once the watermark passes it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("date").alias("dt"), "event_type", "total", "n")


def trailing_counts(events: DataFrame, span: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Distinct users per type in sliding windows, exact: users are windowed first and counted by window then.

    State holds a row per window, type and user, spread by user; a hot type's
    users are never one value. A window leaves the state once the watermark
    passes its end.
    """
    each = events.withWatermark("ts", late).filter("user_id is not null").groupBy(F.window("ts", span, step), "event_type", "user_id").agg(F.count("*").alias("n"))
    w = each.groupBy("window", "event_type").agg(F.count("*").alias("users"), F.sum("n").alias("n"))
    return w.select(F.col("window.end").cast("date").alias("dt"), "event_type", "users", "n")


def matured(events: DataFrame, hours: int = 24) -> DataFrame:
    """Views joined to purchases of the same user up to ``hours`` later: a stream-stream join with a time bound."""
    v = events.filter("event_type = 'view'").select(F.col("user_id").alias("vu"), F.col("ts").alias("seen"), F.col("event_id").alias("view_id")).withWatermark("seen", "2 days")
    p = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"), "value").withWatermark("bought", "2 days")
    on = F.expr(f"vu = user_id and bought > seen and bought <= seen + interval {hours} hours")
    return v.join(p, on).select("view_id", "purchase_id", F.col("vu").alias("user_id"), "value")


class _Sticky(StatefulProcessor):
    """One flag per user: once a value falls to the limit it stays tripped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._flag = handle.getValueState("tripped", StructType([StructField("tripped", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        tripped = bool(self._flag.exists() and self._flag.get()[0])
        n = 0
        for pdf in rows:
            n += len(pdf)
            tripped = tripped or bool((pdf.value <= pdf.floor).any())
        self._flag.update((tripped,))
        yield pd.DataFrame({"user_id": [key[0]], "tripped": [tripped], "n": [n]})

    def close(self) -> None:
        pass


def kill_switch(events: DataFrame, floor: float) -> DataFrame:
    rows = events.select("user_id", "value", F.lit(floor).alias("floor"))
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Sticky(), outputStructType="user_id long, tripped boolean, n long", outputMode="Update", timeMode="None"
    )


_BOOK = "n long, equity double, peak double, worst double, tripped_us long"
SETTLED = "book long, n long, equity double, worst double, tripped boolean, tripped_at timestamp"


class _Drawdown(StatefulProcessor):
    """Adds up the rows of closed intervals in order of time; a book's state is read and written once a batch."""

    def __init__(self, base: float, limit: float) -> None:
        self._base, self._limit = base, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._book = handle.getValueState("book", _BOOK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        until, us, at, pnl = (np.concatenate(c) for c in zip(*((p.until.to_numpy(), p.us.to_numpy(), p.id.to_numpy(float, na_value=-np.inf), p.pnl.to_numpy()) for p in rows), strict=True))
        order = np.lexsort((pnl, at, us))
        until, us = until[order], us[order]
        n, equity, peak, worst, tripped = self._book.get() or (0, self._base, self._base, 0.0, -1)
        equity = np.cumsum(np.concatenate(([equity], pnl[order])))[1:]
        peak = np.maximum.accumulate(np.concatenate(([peak], equity)))[1:]
        drawdown = equity / peak - 1
        worst = np.minimum.accumulate(np.concatenate(([worst], drawdown)))[1:]
        hit = np.flatnonzero(drawdown <= self._limit)
        if tripped < 0 and len(hit):
            tripped = int(us[hit[0]])
        last = np.flatnonzero(np.append(until[1:] != until[:-1], True))  # of each interval
        done = (tripped >= 0) & (tripped < until[last])
        when = np.where(done, np.int64(tripped).astype("datetime64[us]"), np.datetime64("NaT")).astype("datetime64[ns]")
        self._book.update((n + len(us), float(equity[-1]), float(peak[-1]), float(worst[-1]), tripped))
        yield pd.DataFrame({"book": key[0], "n": n + 1 + last, "equity": equity[last], "worst": worst[last], "tripped": done, "tripped_at": when})

    def close(self) -> None:
        pass


def drawdown_switch(pnl: DataFrame, base: float, limit: float, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """A book's settled state after each interval: n, equity, worst drawdown, and whether and when the drawdown first reached ``limit``.

    ``pnl`` streams (book, ts, id, pnl). Equity starts at ``base``; drawdown is
    equity over its running peak less one; once tripped a book stays so. Rows
    count in the order of (ts, id), whatever order they arrive in: an interval
    is settled when the watermark, ``late`` behind the newest row, passes its
    end. Rows that come after that are late and dropped, as by Spark's other
    event-time operators; rows without a book, time or amount leave. A windowed
    aggregation holds the open intervals' rows and lets each interval go once, all
    rows together; a second state behind it holds five numbers a book.
    """
    rows = pnl.filter("book is not null and ts is not null and pnl is not null").withWatermark("ts", late)
    row = F.struct(F.unix_micros("ts").alias("us"), F.col("id").cast("long").alias("id"), F.col("pnl").cast("double").alias("pnl"))
    closed = rows.groupBy(F.window("ts", every), "book").agg(F.collect_list(row).alias("rows"))
    closed = closed.select("book", F.unix_micros("window.end").alias("until"), F.inline("rows"))
    return closed.groupBy("book").transformWithStateInPandas(_Drawdown(base, limit), outputStructType=SETTLED, outputMode="Append", timeMode="None")


def with_rocksdb(spark: SparkSession) -> None:
    """Keep state on the executors' disks, as custom state requires and large state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drain the source once with a checkpoint, and read what was written."""
    spark = stream.sparkSession
    with_rocksdb(spark)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/data").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")
