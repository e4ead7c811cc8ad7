"""The stored catalogue: insertion, update, deletion and ingestion of events as changes of a table on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from festa.operators import catalogue, resolve
from festa.shared import stored
from festa.sources.store import StoredTable

SCHEMA = f"{resolve.EVENT}, priority string, search_text string, first_seen timestamp, updated_at timestamp"
#: What an update of an event never touches.
KEPT = ("province", "first_seen", "alerted")


def events_at(spark: SparkSession, path: str, buckets: int = 16) -> StoredTable:
    return StoredTable(spark, path, SCHEMA, "id", buckets)


def ledger_at(spark: SparkSession, path: str, buckets: int = 16) -> StoredTable:
    """Links with source, title, time and status, one row a link: a later article replaces an earlier one."""
    return StoredTable(spark, path, "link string, source string, title string, seen_at timestamp, status string", "link", buckets)


def _completed(events: DataFrame, now: Column) -> DataFrame:
    return catalogue.with_priority(events).withColumn("updated_at", now)


def readd(ledger: StoredTable, reports: DataFrame, table: StoredTable, now: Column) -> DataFrame:
    """Articles given by hand: link, title, and a report's columns where the cascade found an event; folded whatever the ledger held.

    The ledger's rows of these links are replaced by what comes of them now (new, merged, dup; ``not_event`` without a
    name); gives link and status. ``reports`` holds each link once, with ids that no stored event has.
    """
    asked = stored(reports)
    changes = ingest(table, asked.filter("name is not null"), now)
    told = asked.select("id", "link", "title").join(changes.select(F.col("report_id").alias("id"), "status"), "id", "left")
    entries = stored(told.select("link", F.lit("manual").alias("source"), "title", now.alias("seen_at"), F.coalesce("status", F.lit("not_event")).alias("status")))
    ledger.change(entries)
    return entries.select("link", "status")


def insert(table: StoredTable, events: DataFrame, now: Column) -> int:
    """Events of new ids, not alerted, first seen now."""
    return table.change(_completed(events, now).withColumns({"first_seen": now, "alerted": F.lit(False)}))


def update(table: StoredTable, events: DataFrame, now: Column) -> int:
    """Known events with new fields; province, first_seen and alerted stay; unknown ids add nothing."""
    base = table.version()
    kept = table.read(base).select("id", *KEPT)
    return table.change(_completed(events, now).drop(*KEPT).join(kept, "id"), base=base)


def delete(table: StoredTable, ids: DataFrame) -> int:
    return table.change(gone=ids)


def mark_alerted(table: StoredTable, ids: DataFrame) -> int:
    return table.change(keys=ids, alerted=F.lit(True))


def retire(table: StoredTable, today: Column) -> int:
    """Remove what retention no longer keeps."""
    base = table.version()
    rows = table.read(base)
    return table.change(gone=catalogue.deleted(rows, catalogue.retained_events(rows, today)), base=base)


def ingest(table: StoredTable, reports: DataFrame, now: Column, today: Column | None = None, batch: tuple[str, int] | None = None) -> DataFrame | None:
    """Fold reports (EVENT columns) into the stored events and apply retention, in one version; the changes (report_id, status, event_id).

    ``batch``, a stream's name and batch number, is committed with the result: a batch that the table already holds is
    left alone and gives None. Of the stored events only those in the reports' provinces take part; only buckets of
    events that are new, merged or retired are written.
    """
    base = table.version()
    if batch and (table.note(batch[0], base) is not None and table.note(batch[0], base) >= batch[1]):
        return None
    rows = table.read(base)
    reports = stored(reports.select(*resolve.FIELDS))
    provinces = F.broadcast(reports.select("province").distinct().limit(len(resolve.KEYS) + 1))  # keys of provinces alone
    done = resolve.fold(reports, rows.join(provinces, "province", "left_semi"))
    touched = done.changes.filter("status in ('new', 'merged')").select(F.col("event_id").alias("id")).distinct()
    first = rows.select("id", "first_seen")
    put = _completed(done.events.join(touched, "id", "left_semi").join(first, "id", "left"), now).withColumn("first_seen", F.coalesce("first_seen", now))
    gone = None
    if today is not None:
        put = stored(put.select(*table.schema.names))
        after = catalogue.upserted(rows, put)
        gone = catalogue.deleted(after, catalogue.retained_events(after, today)).select("id")
        put = put.join(gone, "id", "left_anti")
    table.change(put, gone, dict([batch]) if batch else None, base)
    return done.changes.filter("status <> 'known'")
