"""Commands and reports: answers to single users, bounded by their horizons and limits."""

from __future__ import annotations

import os
import zipfile
from datetime import date
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from festa.functions import dates, geo, lexicon, render, text
from festa.operators import catalogue

# What the bot says.
NAMES = ", ".join(shown for shown, _ in lexicon.PROVINCES.values())
HELP = f"""Bot tin lễ hội, sự kiện miền Nam
/homnay – sự kiện đang diễn ra hôm nay
/tuannay – sự kiện trong 7 ngày tới
/tinh <tên tỉnh> – sự kiện 60 ngày tới của một tỉnh (vd: /tinh Cần Thơ)
/sukien <từ khóa> – tìm sự kiện (vd: /sukien pháo hoa)
/excel [tuan|thang] – nhận file Excel danh sách sự kiện
/trangthai – tình trạng hệ thống và các nguồn tin
/tatca – liệt kê mọi sự kiện đang lưu (kiểm tra dữ liệu)
/stop – huỷ nhận tin
/id – xem Chat ID của cuộc trò chuyện này
Tỉnh hỗ trợ: {NAMES}"""
UNKNOWN = "Lệnh không hợp lệ. Gõ /help để xem danh sách lệnh."
OPEN_COMMANDS = ("start", "stop", "help", "id")


def allowed(updates: DataFrame, recipients: DataFrame) -> DataFrame:
    """Updates of known chats, and of any chat with an open command."""
    told = updates.withColumn("cmd", text.parsed_command(F.col("text"))["cmd"])
    known = recipients.select("chat_id", F.lit(True).alias("__known")).distinct()
    return told.join(known, "chat_id", "left").filter(F.coalesce("__known", F.col("cmd").isin(*OPEN_COMMANDS))).drop("__known")


def acted(updates: DataFrame, recipients: DataFrame, code: str = "") -> DataFrame:
    """Updates (chat_id, text, …) with ``action`` and ``reply`` of the commands that need no events: start, stop, help, id, excel.

    With a ``code``, a chat that is no recipient yet joins only by giving it. Other commands have null in both. A chat
    counts as known by ``recipients`` alone, so that all updates of one batch are judged alike.
    """
    parsed = text.parsed_command(F.col("text"))
    told = updates.withColumn("__p", parsed).join(recipients.select("chat_id", F.lit(True).alias("__known")).distinct(), "chat_id", "left")
    cmd, arg = F.col("__p.cmd"), F.col("__p.arg")
    refused = F.lit(code != "") & F.col("__known").isNull() & (F.coalesce(arg, F.lit("")) != code)
    period = F.when(F.lower(arg).isin("thang", "tháng", "month"), "month").otherwise("week")
    action = F.when(cmd == "start", F.when(refused, "refuse").otherwise("join")).when(cmd == "stop", "leave").when(cmd == "excel", period).when(cmd.isin("help", "id"), cmd)
    # What the bot says.
    reply = (
        F.when(F.col("action") == "refuse", "Bot yêu cầu mã tham gia. Gõ: /start <mã>")
        .when(F.col("action") == "join", "Đã đăng ký. Bản tin sự kiện gửi tự động lúc 07:00 mỗi sáng, gõ /stop để huỷ.")
        .when(F.col("action") == "leave", "Đã huỷ nhận tin. Gõ /start để đăng ký lại.")
        .when(F.col("action") == "help", HELP)
        .when(F.col("action") == "id", F.concat(F.lit("Chat ID của bạn: "), F.col("chat_id").cast("string")))
        .when(F.col("action").isin("week", "month"), "Đang tạo file Excel…")
    )
    return told.withColumn("action", action).withColumn("reply", reply).drop("__p", "__known")


def chats(updates: DataFrame) -> DataFrame:
    """chat_id and name of every chat that wrote, as the last update (by update_id) names it."""
    name = F.coalesce(F.nullif("title", F.lit("")), F.nullif("username", F.lit("")), F.col("first_name"), F.lit(""))
    return updates.filter("chat_id is not null").groupBy("chat_id").agg(F.max_by(name, "update_id").alias("name"))


def _scalar(events: DataFrame, column) -> object:
    return events.sparkSession.range(1).select(column).first()[0]


def status(events: DataFrame, recipients: DataFrame, health: DataFrame, ledger: DataFrame, notes: dict[str, str] | None = None) -> DataFrame:
    """The lines (place, line) of the system's state: counts, notes of the last runs, the ledger by status, each failing source.

    ``health``: source_id, name, fails, last_error. Statuses stand by number, then name; sources by id. Every table is
    aggregated where it lies; lines grow with the failing sources alone.
    """
    spark, told = events.sparkSession, notes or {}
    # What the bot says.
    never = "chưa có"
    labels = [("Lần thu thập gần nhất: ", "last_collect"), ("Bản tin gần nhất: ", "last_digest_date")]
    later = [("AI: ", "llm_state"), ("AI tìm sự kiện: ", "last_discover"), ("AI tìm sáng (7 ngày tới): ", "last_morning"), ("Giải mã link Google News (lượt gần nhất): ", "last_gn")]
    count = lambda c=F.lit(1): F.count(c).cast("string")
    failing = health.filter("fails > 0")
    by_status = ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), F.col("status").alias("status"))))  # a few statuses
    shown = F.array_join(F.transform(pairs, lambda p: F.concat(F.coalesce(p["status"], F.lit("None")), F.lit("="), (-p["down"]).cast("string"))), ", ")
    one = lambda place, df, line: df.agg(line.alias("line")).select(F.lit(place).alias("place"), F.lit("").alias("key"), "line")
    fixed = [(4 + i, "", f"{label}{told.get(key) or never}") for i, (label, key) in enumerate(labels)] + [(7 + i, "", f"{label}{told.get(key) or never}") for i, (label, key) in enumerate(later)]
    lines = (
        one(1, events, F.concat(F.lit("Số sự kiện đang lưu: "), count()))
        .unionByName(one(2, recipients.select("chat_id").distinct(), F.concat(F.lit("Số người nhận tin: "), count())))
        .unionByName(spark.createDataFrame(fixed, "place int, key string, line string"))
        .unionByName(one(6, health, F.concat(F.lit("Nguồn: "), count(), F.lit(" (lỗi: "), count(F.when(F.col("fails") > 0, 1)), F.lit(")"))))
        .unionByName(one(11, by_status, F.concat(F.lit("Bài đã xử lý: "), F.coalesce(F.nullif(shown, F.lit("")), F.lit(never)))))
        .unionByName(failing.select(F.lit(12).alias("place"), F.col("source_id").alias("key"), F.concat(F.lit(" - "), F.coalesce("name", "source_id"), F.lit(": lỗi "), F.col("fails").cast("string"), F.lit(" lần – "), F.substring(F.coalesce("last_error", F.lit("")), 1, 80)).alias("line")))
    )
    return lines.orderBy("place", "key")


def answer(events: DataFrame, message: str, today: date, days: int = 7, state: DataFrame | None = None) -> list[str]:
    """The messages that answer one command over the catalogue (with priority and search text); ``state``: the lines of ``status``."""
    t = F.lit(today)
    parsed = _scalar(events, text.parsed_command(F.lit(message)))
    cmd, arg = parsed["cmd"], parsed["arg"]
    if cmd == "help":
        return [HELP]
    if cmd == "homnay":
        title, found = f"SỰ KIỆN HÔM NAY {today:%d/%m/%Y}: {{}}", catalogue.events_between(events, t, t)
    elif cmd in ("tuannay", "tuan"):
        title, found = f"SỰ KIỆN {days} NGÀY TỚI ({{}})", catalogue.events_between(events, t, F.date_add(t, days - 1))
    elif cmd == "tinh":
        key = _scalar(events, geo.resolve_province(F.lit(arg)))
        if not key:
            return [f"Không nhận ra tỉnh “{arg}”. Tỉnh hỗ trợ: {NAMES}" if arg else f"Cú pháp: /tinh <tên tỉnh>\nVí dụ: /tinh Cần Thơ\nTỉnh hỗ trợ: {NAMES}"]
        title, found = f"SỰ KIỆN 60 NGÀY TỚI – {lexicon.PROVINCES[key][0].upper()} ({{}})", catalogue.events_between(events, t, F.date_add(t, 60), key)
    elif cmd == "sukien":
        if not arg:
            return ["Cú pháp: /sukien <từ khóa>\nVí dụ: /sukien pháo hoa, /sukien Ok Om Bok"]
        title, found = f"KẾT QUẢ CHO “{arg}” ({{}})", catalogue.search(events, arg, t)
    elif cmd == "tatca":
        return [_everything(events, today)]
    elif cmd == "trangthai" and state is not None:
        return ["\n".join(r["line"] for r in state.collect())]
    else:
        return [UNKNOWN if cmd else "Gõ /help để xem các lệnh."]
    row = render.listing(found, F.lit("\u0001")).first()
    whole = row["text"].replace("\u0001", title.format(row["events"]), 1)
    return _scalar(events, text.split_message(F.lit(whole)))


def _everything(events: DataFrame, today: date, most: int = 40) -> str:
    now = catalogue.current(events, F.lit(today))
    line = F.concat_ws(" · ", render.date_range(F.col("start_date"), F.col("end_date")), geo.province_name(F.col("province")), F.substring("name", 1, 70))
    lines = [r[0] for r in now.select(line).limit(most).collect()]
    count = now.count()
    return "\n".join([f"Đang lưu {count} sự kiện:", *(f"{i}. {x}" for i, x in enumerate(lines, 1))]) if count else "DB chưa có sự kiện nào."


def _sheet(rows: list[tuple]) -> str:
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else f"{v:%d/%m/%Y}" if isinstance(v, date) else str(v))}</t></is></c>'
    body = "".join(f'<row r="{i}">{"".join(map(cell, r))}</row>' for i, r in enumerate(rows, 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def export(events: DataFrame, period: str, today: date, folder: str) -> str:
    """A workbook of the week's or month's events; the period bounds its rows."""
    span = _scalar(events, dates.period_range(F.lit(period), F.lit(today)))
    table = render.report_rows(catalogue.events_between(events, F.lit(span["start"]), F.lit(span["end"])))
    rows = [tuple(table.columns), *map(tuple, table.collect())]
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"su-kien-{period}-{span['start']:%Y%m%d}.xlsx")
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    kind, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{kind}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{kind}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets><sheet name="Sự kiện" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{kind}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", _sheet(rows))
    return path
