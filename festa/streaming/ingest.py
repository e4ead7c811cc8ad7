"""Structured Streaming: items seen once, source health, and events resolved as reports come in.

State is small and bounded: a number for each link of the ledger's 90 days, two numbers for each source, and the stored
events, a row each, which retention removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from festa.operators.catalogue import RETRY_STATUSES
from festa.operators.stored import events_at, ingest
from festa.shared import stored

LEDGER_DAYS, FEED_DAYS, RETRY_HOURS = 90, 45, 6
NOTIFY_AFTER = 3


def seen_once(items: DataFrame, at: str = "ingest_ts") -> DataFrame:
    """Each link's first item within the ledger's days. The same call serves a stream and a batch."""
    if items.isStreaming:
        return items.withWatermark(at, f"{LEDGER_DAYS} days").dropDuplicatesWithinWatermark(["link"])
    first = F.min_by(F.struct(*[c for c in items.columns if c != "link"]), F.col(at))
    return items.groupBy("link").agg(first.alias("r")).select("link", "r.*")


def fresh(items: DataFrame, today) -> DataFrame:
    """Without items published over 45 days ago; undated ones stay."""
    return items.filter(F.col("published").isNull() | (F.col("published") >= F.date_sub(today, FEED_DAYS)))


_HEALTH = "source_id string, seq bigint, notice string, fails int, last_error string"


def _health(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Failures in a row; one notice at the third, one when the source works again."""
    fails, notified = state.get if state.exists else (0, False)
    out = []
    rows = sorted((r for f in frames for r in f[["seq", "ok", "error"]].itertuples(index=False)), key=lambda r: r.seq)
    for r in rows:
        if r.ok:
            if notified:
                out.append((key[0], r.seq, "recovered", 0, None))
            fails, notified = 0, False
        else:
            fails += 1
            if fails >= NOTIFY_AFTER and not notified:
                out.append((key[0], r.seq, "failing", fails, r.error))
                notified = True
    state.update((int(fails), bool(notified)))
    yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _HEALTH.split(", ")]).astype({"fails": "int32", "seq": "int64"})


def source_notices(runs: DataFrame) -> DataFrame:
    """Notices from runs (source_id, seq, ok, error): a source fails, a source has recovered."""
    return runs.groupBy("source_id").applyInPandasWithState(_health, _HEALTH, "fails int, notified boolean", "append", GroupStateTimeout.NoTimeout)


def resolve_into(reports: DataFrame, events: str, folder: str) -> StreamingQuery:
    """Start a stream of reports (EVENT columns and ``today``) into the stored events at ``events``; its changes by batch below ``folder``.

    State is the table, a row an event, which retention shrinks by the batch's last ``today`` (none if all are null). A batch is
    folded as ``resolve.fold`` does and committed with its number; a repeated batch changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = stored(rows)
        last = rows.agg(F.max("today")).first()[0]
        today = None if last is None else F.lit(last).cast("date")
        now = F.current_timestamp() if last is None else F.lit(last).cast("timestamp")
        changes = ingest(events_at(spark, events), rows, now, today, (folder, number))
        if changes is not None:
            changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return reports.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


LEDGER_ITEM = "link string, status string, at timestamp"


class _Entries(StatefulProcessor):
    """One live entry a link; it frees the link after six hours if the article could not be read, else after 90 days."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", "until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live = self.entry.get()[0] if self.entry.exists() else None
        admitted, before = [], live
        for r in sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: (r.ms, r.status)):
            if live is None or r.ms >= live:
                admitted.append((key[0], r.status, r.at))
                live = int(r.ms) + 3_600_000 * (RETRY_HOURS if r.status in RETRY_STATUSES else 24 * LEDGER_DAYS)
        if live != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.entry.update((live,))
            self.handle.registerTimer(live)
        yield pd.DataFrame(admitted, columns=["link", "status", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield pd.DataFrame([], columns=["link", "status", "at"])

    def close(self) -> None:
        pass


def admitted_once(items: DataFrame, late: str = "1 hour") -> DataFrame:
    """The items (LEDGER_ITEM) of a stream whose link no live entry holds: state is one number a link, cleared by a timer.

    Entries follow the items' own times, so that a repeated run gives the same rows. Needs the RocksDB state store (``drained``
    sets it). Several items of a link are taken in the order of their times. Rows without link or time are left out.
    """
    rows = items.filter(F.col("link").isNotNull() & F.col("at").isNotNull())
    at = F.col("at").cast("timestamp")
    rows = rows.select("link", F.coalesce("status", F.lit("")).alias("status"), at.alias("at"), F.unix_millis(at).alias("ms"))
    return rows.withWatermark("at", late).groupBy("link").transformWithStateInPandas(_Entries(), LEDGER_ITEM, "Append", "EventTime")


def drained(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Run a stream over what its source holds now and read what it wrote."""
    spark, store = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}/out").option("checkpointLocation", f"{folder}/{name}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(store, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}/out")
