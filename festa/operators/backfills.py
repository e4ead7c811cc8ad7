"""One-shot jobs over stored tables: named, applied in order, and recorded in the same commit as their result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from festa.functions.geo import held_elsewhere
from festa.functions.text import not_vietnamese
from festa.operators import catalogue, resolve
from festa.shared import stored
from festa.sources.store import StoredTable

#: A job takes the table's rows and gives the rows to put and the rows to remove (either may be None).
Job = Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None]]
DONE = "jobs"


def apply(table: StoredTable, jobs: dict[str, Job]) -> list[str]:
    """Run the jobs that the table has not recorded, in their order; the names of those that ran.

    A job's result and its name are one commit: a job that stopped half-way has left nothing and runs whole the next time, one
    that is recorded never runs again. If another writer commits meanwhile, the job is worked out again.
    """
    ran = []
    for name, job in jobs.items():
        done = table.note(DONE) or []
        if name in done:
            continue
        base = table.version()
        put, gone = job(table.read(base))
        table.change(put, gone, {DONE: [*done, name]}, base)
        ran.append(name)
    return ran


def merge_duplicates(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and dates as rules would give them now, events of one event merged into the first."""
    rows = events.select(*resolve.FIELDS)
    after = stored(resolve.deduplicated(rows))
    old = events.drop(*[c for c in resolve.FIELDS if c != "id"])
    return catalogue.with_priority(after.join(old.drop("priority", "search_text"), "id")), catalogue.deleted(rows, after)


def prune_elsewhere(events: DataFrame) -> tuple[None, DataFrame]:
    """Events that take place elsewhere go."""
    return None, events.filter(F.coalesce(held_elsewhere(F.col("name"), F.col("summary")), F.lit(False)))


def prune_foreign(events: DataFrame) -> tuple[None, DataFrame]:
    """Events from articles in other languages go."""
    return None, events.filter(not_vietnamese(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("summary", F.lit("")))))


def prune_noise(events: DataFrame) -> tuple[None, DataFrame]:
    """Events for which ``catalogue.pruned`` gives a reason go."""
    return None, catalogue.pruned(events).filter("why is not null")


def forget(*statuses: str) -> Job:
    """Links of these statuses are taken up again; of all, if none is named."""
    return lambda ledger: (None, ledger.filter(F.col("status").isin(*statuses)) if statuses else ledger)


EVENT_JOBS: dict[str, Job] = {"merge_duplicates_1": merge_duplicates, "prune_elsewhere_1": prune_elsewhere, "prune_foreign_1": prune_foreign}
LEDGER_JOBS: dict[str, Job] = {"forget_all_3": forget()}
#: When a language model is first at hand, it sees again what rules turned down.
MODEL_JOBS: dict[str, Job] = {"forget_turned_down_1": forget("not_event", "title_only", "no_body")}


def purge(ledger: StoredTable, now: Column, retry_hours: int = 6) -> int:
    """Before each run: links that could not be read free up after some hours, all others after retention."""
    base = ledger.version()
    rows = ledger.read(base)
    retry = F.col("status").isin(*catalogue.RETRY_STATUSES) & (F.col("seen_at") < now - F.expr(f"interval {retry_hours} hours"))
    old = F.col("seen_at") < F.date_sub(now.cast("date"), catalogue.RETENTION_DAYS)
    return ledger.change(gone=rows.filter(retry | old), base=base)
