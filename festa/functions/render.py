"""Messages as columns: ranges of dates, events, digests, lists, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from festa.functions import facts, lexicon
from festa.functions.geo import province_name

# The words of the messages.
NO_DATE, NO_VENUE, NO_SIZE = "chưa rõ ngày", "chưa rõ (xem nguồn)", "Không rõ"
FIREWORKS, CONCERT = "có bắn pháo hoa", "đại nhạc hội/countdown"
NO_SOURCE = "Nguồn: AI tìm kiếm Google (nên đối chiếu)"
DIGEST_HEAD, DIGEST_FOOT = "BẢN TIN SỰ KIỆN MIỀN NAM", "Gõ /tuannay để xem đầy đủ, /tinh <tên tỉnh> để lọc."
DIGEST_EMPTY = "ngày tới: chưa ghi nhận sự kiện nào.\n\nGõ /sukien <từ khóa> để tra cứu."
LIST_EMPTY = "Chưa có sự kiện nào được ghi nhận."
ALERT_HEAD = "🚨 CẢNH BÁO SỰ KIỆN QUY MÔ LỚN"


def number(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))


def date_range(start: Column, end: Column) -> Column:
    last = F.coalesce(end, start)
    d, m = (lambda c: F.dayofmonth(c).cast("string")), (lambda c: F.month(c).cast("string"))
    both = lambda c: F.concat(d(c), F.lit("/"), m(c))
    same_month = F.trunc(start, "MM") == F.trunc(last, "MM")
    return (
        F.when(start.isNull(), NO_DATE)
        .when(start == last, both(start))
        .when(same_month, F.concat(d(start), F.lit("–"), d(last), F.lit("/"), m(start)))
        .otherwise(F.concat(both(start), F.lit("–"), both(last)))
    )


def shown_crowd(crowd: Column, limit: int = facts.LARGE_CROWD) -> Column:
    return F.when(crowd >= limit, crowd)


def main_source(sources: Column) -> Column:
    return F.get(sources, F.lit(0))


def large_reasons(limit: int = facts.LARGE_CROWD) -> Column:
    size = F.when(F.col("crowd") >= limit, F.concat(F.lit("quy mô ≥ "), number(F.lit(limit)), F.lit(" người")))
    return F.concat_ws("; ", size, F.when(F.col("fireworks"), FIREWORKS), F.when(F.col("big_concert"), CONCERT))


def event_text(summary: bool = False) -> Column:
    """One event's lines, from the columns of the catalogue."""
    label = F.coalesce(*[F.when(F.col("priority") == k, v) for k, v in lexicon.PRIORITIES.items()], F.lit(lexicon.PRIORITIES["THAP"]))
    crowd = shown_crowd(F.col("crowd"))
    scale = F.concat_ws(" · ", F.coalesce(F.concat(F.lit("~"), number(crowd), F.lit(" người")), F.lit(NO_SIZE)), F.when(F.col("fireworks"), FIREWORKS), F.when(F.col("big_concert"), CONCERT))
    source = main_source(F.col("sources"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), label, F.lit("] "), date_range(F.col("start_date"), F.col("end_date")), F.lit(" · "), province_name(F.col("province"))),
        F.col("name"),
        F.concat(F.lit("Địa điểm: "), F.coalesce(F.nullif(F.col("venue"), F.lit("")), F.lit(NO_VENUE))),
        F.concat(F.lit("Quy mô: "), scale),
        F.concat(F.lit("Tóm tắt: "), F.nullif(F.col("summary"), F.lit(""))) if summary else F.lit(None).cast("string"),
        F.coalesce(F.concat(F.lit("Nguồn: "), source), F.lit(NO_SOURCE)),
    )


def _joined(events: DataFrame, texts: Column, most: int | None = None) -> DataFrame:
    """One row: the number of events, of large ones, and their texts in order (start, priority, name)."""
    rank = F.when(F.col("priority") == "CAO", 0).when(F.col("priority") == "TB", 1).otherwise(2)
    large = facts.is_large(F.col("crowd"), F.col("fireworks"), F.col("big_concert"))
    counts = [F.count(F.lit(1)).alias("events"), F.count_if(large).alias("large")]
    ordered = F.array_sort(F.collect_list(F.struct(F.col("start_date").alias("d"), rank.alias("r"), F.col("name").alias("n"), F.col("id").alias("i"), texts.alias("t"))))
    body = F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("body")
    if most is None:
        return events.agg(*counts, body)
    first = events.orderBy("start_date", rank, "name", "id").limit(most)
    return events.agg(*counts).crossJoin(first.agg(body))  # one row each


def digest(events: DataFrame, today: Column, days: int, hour: int = 7) -> DataFrame:
    """One row with the daily message over events of the coming days, a report that the horizon bounds."""
    day = F.element_at(F.array(*map(F.lit, lexicon.WEEKDAYS)), F.weekday(today) + 1)
    head = F.concat(F.lit(f"{DIGEST_HEAD} — {hour:02d}:00 "), day, F.lit(" "), F.date_format(today, "dd/MM/yyyy"))
    big = F.when(F.col("large") > 0, F.format_string(" (%d quy mô lớn)", F.col("large"))).otherwise("")
    counts = F.concat(F.lit(f"{days} ngày tới: "), F.col("events").cast("string"), F.lit(" sự kiện"), big)
    full = F.concat(head, F.lit("\n"), counts, F.lit("\n\n"), F.col("body"), F.lit(f"\n\n{DIGEST_FOOT}"))
    return _joined(events, event_text()).select(F.when(F.col("events") == 0, F.concat(head, F.lit(f"\n{days} {DIGEST_EMPTY}"))).otherwise(full).alias("text"), "events", "large")


def listing(events: DataFrame, title: Column, most: int = 25, summary: bool = False) -> DataFrame:
    """One row with up to ``most`` events under a title."""
    rest = F.when(F.col("events") > most, F.concat(F.lit("\n\n… và "), (F.col("events") - most).cast("string"), F.lit(" sự kiện khác (thu hẹp bằng /tinh hoặc /sukien)."))).otherwise("")
    full = F.concat(title, F.lit("\n\n"), F.col("body"), rest)
    return _joined(events, event_text(summary), most).select(F.when(F.col("events") == 0, F.concat(title, F.lit(f"\n{LIST_EMPTY}"))).otherwise(full).alias("text"), "events")


def alerts(events: DataFrame) -> DataFrame:
    """id and alert text of each event."""
    return events.select("id", F.concat(F.lit(f"{ALERT_HEAD}\nLý do: "), large_reasons(), F.lit("\n\n"), event_text(True)).alias("text"))


def report_rows(events: DataFrame) -> DataFrame:
    """The twelve columns of the weekly or monthly table."""
    yes = lambda c: F.when(F.col(c), "Có").otherwise("")
    return events.select(
        F.col("start_date").alias("Từ ngày"), F.coalesce("end_date", "start_date").alias("Đến ngày"), F.col("start_time").alias("Giờ"), province_name(F.col("province")).alias("Tỉnh/TP"), F.col("name").alias("Tên sự kiện"), F.col("venue").alias("Địa điểm"),
        F.coalesce(shown_crowd(F.col("crowd")).cast("string"), F.lit(NO_SIZE)).alias("Quy mô (người)"), yes("fireworks").alias("Pháo hoa"), yes("big_concert").alias("Đại nhạc hội"),
        F.coalesce(*[F.when(F.col("priority") == k, v) for k, v in lexicon.PRIORITIES.items()]).alias("Mức ưu tiên"), F.col("summary").alias("Tóm tắt"), main_source(F.col("sources")).alias("Nguồn"),
    )
