"""Replies to commands from a stream of updates: written at least once, made unique by the update's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from festa.plans import serve
from festa.shared import stored
from festa.sources.store import StoredTable
from festa.streaming.alerts import Sender


def replies_at(spark: SparkSession, path: str) -> StoredTable:
    return StoredTable(spark, path, "update_id bigint, chat_id string, action string, reply string, delivered boolean", "update_id", 4)


def offset(table: StoredTable) -> int | None:
    """The update that a connector asks for next: one past the last that has its row; None before the first."""
    return table.note("offset")


def reply_once(updates: DataFrame, table: StoredTable, recipients: DataFrame, send: Sender, code: str = "", batch: int = 0) -> int:
    """Answer updates (update_id, chat_id, text) that have no row yet; the number delivered now.

    First every new update gets its row with the reply, in one version of the table with the batch's number and the next
    offset; then all rows without delivery go to the sender, and only those that it reports as delivered (by ``event_id``,
    which is the update's id) are marked. A batch that fails between the two is repeated: its updates already have rows,
    so they are not judged again, and only what was not delivered is sent. Updates without chat or reply need no delivery.
    Rows that repeat an update_id are one update, of them the first by chat and text; rows without one are left out.
    """
    if table.note("batch") is None or table.note("batch") < batch:
        rows = updates.filter("update_id is not null").groupBy("update_id").agg(F.min(F.struct("chat_id", "text")).alias("u")).select("update_id", "u.*")
        new = stored(rows.join(table.read().select("update_id"), "update_id", "left_anti"))
        last = new.agg(F.max("update_id")).first()[0]
        done = serve.acted(new, recipients, code)
        told = done.select("update_id", "chat_id", "action", "reply", (F.col("reply").isNull() | F.col("chat_id").isNull()).alias("delivered"))
        known = offset(table)
        table.change(told, notes={"batch": batch, "offset": known if last is None else max(known or 0, last + 1)})
    waiting = table.read().filter("not delivered")
    if waiting.isEmpty():
        return 0
    sent = send(waiting.select(F.col("update_id").alias("event_id"), "chat_id", F.col("reply").alias("message")))
    done = stored(waiting.join(sent.select(F.col("event_id").alias("update_id")).distinct(), "update_id", "left_semi"))
    table.change(done.withColumn("delivered", F.lit(True)))
    return done.count()


def replying(updates: DataFrame, path: str, folder: str, recipients: DataFrame, send: Sender, code: str = "") -> StreamingQuery:
    """Start a stream of updates whose replies stand in the table at ``path``; a restart goes on from the checkpoint in ``folder``."""

    def batch(rows: DataFrame, number: int) -> None:
        reply_once(rows, replies_at(rows.sparkSession, path), recipients, send, code, number + 1)

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
