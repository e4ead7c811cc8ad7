"""What is due: gates and rotations as filters over small state tables. A trigger calls these; none of them waits."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from festa.operators import catalogue
from festa.shared import running


@dataclass(frozen=True)
class Options:
    """The engine's parameters."""

    lookahead_days: int = 7
    large_crowd: int = 10_000
    digest_hour: int = 7
    collect_interval_min: int = 120
    fail_alert_threshold: int = 3
    max_article_fetch: int = 50
    enrich_max: int = 10
    discover_per_run: int = 8
    batch_max: int = 2

    @classmethod
    def read(cls, settings: dict[str, str]) -> Options:
        """From settings by upper-case name; a blank or a bad number leaves the default."""
        found = {}
        for f in fields(cls):
            try:
                found[f.name] = int(str(settings.get(f.name.upper(), "")).strip())
            except ValueError:
                continue
        return cls(**found)


def chat_ids(setting: str) -> list[str]:
    return [x for x in (p.strip() for p in setting.replace(";", ",").split(",")) if x]


def collect_due(last: datetime | None, now: datetime, options: Options = Options()) -> bool:
    return last is None or (now - last).total_seconds() >= 60 * options.collect_interval_min


def digest_due(last_day: str | None, now: datetime, options: Options = Options()) -> bool:
    """Once a day, from the digest hour until ten in the evening."""
    return options.digest_hour <= now.hour < 22 and last_day != f"{now:%Y-%m-%d}"


def exports_due(done: dict[str, str], now: datetime) -> list[str]:
    """The week's table on Mondays, the month's on the first; each once."""
    due = [("week", now.weekday() == 0), ("month", now.day == 1)]
    return [period for period, today in due if today and done.get(period) != f"{now:%Y-%m-%d}"]


def morning_due(tries: int, done: bool, now: datetime, options: Options = Options()) -> bool:
    return options.digest_hour - 1 <= now.hour < 22 and not done and tries < 2


def provinces_due(state: DataFrame, now: Column, most: int, hours: int = 24) -> DataFrame:
    """Provinces (province, asked_at) that were not asked for a day, the longest ago first."""
    old = F.col("asked_at").isNull() | (F.col("asked_at") <= now - F.expr(f"interval {hours} hours"))
    return state.filter(old).orderBy(F.col("asked_at").asc_nulls_first(), "province").limit(most)


def events_due(events: DataFrame, tries: DataFrame, today: Column, now: Column, most: int, retries: int = 8, hours: int = 6) -> DataFrame:
    """Events to look up again: pending, tried under eight times and not within six hours."""
    told = catalogue.pending(events, today).join(tries, "id", "left")
    able = (F.coalesce("tries", F.lit(0)) < retries) & (F.col("tried_at").isNull() | (F.col("tried_at") <= now - F.expr(f"interval {hours} hours")))
    return told.filter(able).orderBy(F.col("start_date").isNull(), "start_date", "id").limit(most)


def admitted(items: DataFrame, most: int) -> DataFrame:
    """The newest items of a run; the others stay unseen for the next one."""
    return items.orderBy(F.col("published").desc_nulls_last(), "link").limit(most)


def within_budget(rows: DataFrame, cost: Column, budget: float, *order: Column, reserve: float = 0.0) -> DataFrame:
    """The rows that a loop would begin which stops as soon as less than ``reserve``, or nothing, is left of its budget.

    A row may overdraw the budget, as work once begun is done; negative and null costs count as none. ``order`` is a total order.
    """
    spent = running(rows, F.greatest(cost, F.lit(0)), *order)
    left = F.lit(float(budget)) - F.col("before")
    return spent.filter((left > 0) & (left >= reserve)).drop("before")


def until(rows: DataFrame, stop: Column, *order: str, inclusive: bool = False) -> DataFrame:
    """The rows before the first one, in the order of the columns (nulls first), at which ``stop`` holds (null: it does not); all if it never does.

    ``inclusive``: with that row too, as when a result ends the search. One aggregation to one row; no sort.
    """
    place = F.struct(*order)
    first = rows.filter(F.coalesce(stop, F.lit(False))).agg(F.min(place)).scalar()
    return rows.filter(first.isNull() | (place <= first if inclusive else place < first))


def deadline_before(budget: float) -> float:
    """When reading articles must end so that a run of ``budget`` seconds can finish: earlier by a third, at most 90 seconds."""
    return budget - min(90, budget // 3)
