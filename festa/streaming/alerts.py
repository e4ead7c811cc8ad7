"""Alerts of large events, each delivered once: an outbox on disk between the catalogue and whatever sends messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from festa.functions import render
from festa.operators import catalogue
from festa.operators.stored import events_at, mark_alerted
from festa.shared import stored
from festa.sources.store import StoredTable

#: Sends messages (event_id, message) and returns the ids (event_id) of those that were delivered.
Sender = Callable[[DataFrame], DataFrame]


def outbox_at(spark: SparkSession, path: str) -> StoredTable:
    return StoredTable(spark, path, "event_id bigint, message string, batch bigint, delivered boolean", "event_id", 4)


def deliver(events: StoredTable, outbox: StoredTable, send: Sender, today: Column, batch: int = 0) -> int:
    """Alert the large events that no alert was delivered of; the number delivered now.

    What is due is first written to the outbox, once an event and a batch; then everything there that was not delivered is
    sent, and only what the sender reports as delivered is marked, in the outbox and then on the events. So a sender that
    fails, or delivers in part, is asked again for the rest in the next batch, and a repeated batch finds nothing to
    send. A crash between sending and marking sends again under the same ``event_id``, by which a sender can tell repeats.
    """
    if outbox.note("batch") is None or outbox.note("batch") < batch:
        texts = render.alerts(catalogue.unalerted_large(events.read(), today))
        due = texts.select(F.col("id").alias("event_id"), F.col("text").alias("message"), F.lit(batch).alias("batch"), F.lit(False).alias("delivered"))
        outbox.change(due.join(outbox.read().select("event_id"), "event_id", "left_anti"), notes={"batch": batch})
    waiting = outbox.read().filter("not delivered")
    count = 0
    if not waiting.isEmpty():
        done = stored(waiting.join(send(waiting.select("event_id", "message")).select("event_id").distinct(), "event_id", "left_semi"))
        count = done.count()
        outbox.change(done.withColumn("delivered", F.lit(True)))
    told = outbox.read().filter("delivered").select(F.col("event_id").alias("id"))
    unmarked = events.read().filter("not alerted").select("id").join(told, "id", "left_semi")
    if not unmarked.isEmpty():
        mark_alerted(events, unmarked)
    return count


def alert_after(changes: DataFrame, events: str, outbox: str, folder: str, send: Sender, today: Column) -> StreamingQuery:
    """Start a stream: after each batch of ``changes`` (any rows) the stored events at ``events`` are alerted once."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        deliver(events_at(spark, events), outbox_at(spark, outbox), send, today, number + 1)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
