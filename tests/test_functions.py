"""Single columns over small tables of cases."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from festa.functions import dates, facts, geo, lexicon, lunar, names, render, text

REF = date(2026, 10, 2)


def d(s):
    return date.fromisoformat(s)


@pytest.fixture(scope="module")
def run(spark):
    def run(rows, column, schema="t string"):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]

    return run



@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    global T
    T = F.col("t")



def test_dates(run):
    cases = {
        "diễn ra từ ngày 5 đến 8/11": [("2026-11-05", "2026-11-08")],
        "vào ngày 9 tháng 12": [("2026-12-09", "2026-12-09")],
        "3/11-6/11/2026": [("2026-11-03", "2026-11-06")],
        "20-22/11 và 5/12": [("2026-11-20", "2026-11-22"), ("2026-12-05", "2026-12-05")],
        "12 và 13/11": [("2026-11-12", "2026-11-13")],
        "từ 29 tháng 11 đến ngày 3 tháng 12 năm 2026": [("2026-11-29", "2026-12-03")],
        "hôm 25/9": [("2026-09-25", "2026-09-25")],
        "ngày 30/2 và 31/4": [],
        "30/12 đến 2/1": [("2026-12-30", "2027-01-02")],
        "ngày 5/1": [("2027-01-05", "2027-01-05")],
        "năm 2019: 5/6/2019": [],
        "từ 3.11 đến 5.11.2026": [("2026-11-03", "2026-11-05")],
        "tăng 3.5 triệu, 7.5%": [],
        "hạn trước ngày 17-18/10": [],
        "ngày 15/8 âm lịch": [("2026-09-25", "2026-09-25")],
        "14-15/8 âm lịch (24-25/9)": [("2026-09-24", "2026-09-25"), ("2026-09-24", "2026-09-25")],
        "15 tháng 10 âm lịch": [("2026-11-23", "2026-11-23")],
        "": [],
    }
    got = run(cases, dates.find_dates(T, F.lit(REF)))
    assert [[(str(x.start), str(x.end)) for x in r] for r in got] == list(cases.values())
    chosen = run(["1/9 rồi 7/11", "1/9"], dates.choose_date(dates.find_dates(T, F.lit(REF)), F.lit(REF)))
    assert [str(c.start) for c in chosen] == ["2026-11-07", "2026-09-01"]


def test_lunar_new_years_and_months():
    table = lunar.month_starts()
    days = {2020: "2020-01-25", 2021: "2021-02-12", 2022: "2022-02-01", 2023: "2023-01-22", 2024: "2024-02-10", 2025: "2025-01-29", 2026: "2026-02-17", 2027: "2027-02-06", 1985: "1985-01-21", 2007: "2007-02-17", 1968: "1968-01-29"}
    assert all(str(np.datetime64(int(table[y - lunar.FIRST_YEAR, 0]), "D")) == day for y, day in days.items())
    flat = table.ravel()
    assert set(np.diff(flat)) <= {29, 30, 58, 59, 60}  # a leap month lies within a gap of two


def test_times(run):
    cases = {"lúc 7h05": "07:05", "từ 21 giờ": "21:00", "khu đất 12ha": "", "mở cửa 9:30": "09:30", "8 giờ 45 sáng": "08:45", "19h": "19:00", "tỉ số 3:2": "", "": ""}
    assert run(cases, dates.find_time(T)) == list(cases.values())


def test_crowds(run):
    cases = {"khoảng 25.000 người": 25000, "12 nghìn lượt khách": 12000, "2,5 triệu lượt khách": 2500000, "hàng vạn người": 10000, "3 triệu lượt khách mỗi năm": None, "đón 4 triệu du khách năm 2025": None, "50 người": None, "200 người, sau đó 1.500 khán giả": 1500, "không rõ": None}
    assert run(cases, facts.find_crowd(T)) == list(cases.values())


def test_flags(run):
    assert run(["có pháo hoa", "không bắn pháo hoa", "dừng bắn pháo", "không có nhạc; về khuya người dân sẽ xem pháo hoa"], facts.has_fireworks(T)) == [True, False, False, True]
    assert run(["Đại nhạc hội", "hủy countdown", "đêm thơ"], facts.has_big_concert(T)) == [True, False, False]


def test_venues(run):
    cases = {"tổ chức tại Công viên Bến Bạch Đằng vào tối nay": "Công viên Bến Bạch Đằng", "tại Đồng Tháp": "", "tại nhà văn hóa": "", "Địa điểm: Nhà thi đấu Phú Thọ; vé": "Nhà thi đấu Phú Thọ", "tại Sân vận động Cần Thơ, phường Cái Khế": "Sân vận động Cần Thơ, phường Cái Khế", "ở xã Mỹ Khánh, từ sáng": "xã Mỹ Khánh"}
    assert run(cases, facts.venue_and_ward(T)) == list(cases.values())


def test_provinces(run):
    score = geo.scores(T, F.lit(""))
    cases = {"Chủ tịch Hồ Chí Minh": None, "Nhạc hội tại TP.HCM": "hcm", "Du lịch Phú Quốc": "angiang", "Chợ nổi Sóc Trăng": "cantho", "Tri ân người thầy": None, "Cà Mau và Cần Thơ": "cantho"}
    assert run(cases, geo.detect_province(score)) == list(cases.values())
    assert run([("x", "camau"), ("x", "nowhere")], geo.detect_province(score, F.col("h")), "t string, h string") == ["camau", None]
    assert run(["can tho", "HCM", "sg", "", "tỉnh Bến Tre", "Huế"], geo.resolve_province(T)) == ["cantho", "hcm", "hcm", None, "vinhlong", None]
    assert run(["Kon Tum", "Thủ đô Hà Nội", "Cần Thơ"], score["elsewhere"]) == [6, 9, 0]
    assert run(["Lễ hội ở Huế", "Đoàn Cà Mau ra Huế"], geo.title_elsewhere(T)) == [True, False]
    assert run([("Đoàn Cà Mau biểu diễn", "tại Hà Nội"), ("Hội hoa", "tại Hà Nội và tại Cần Thơ")], geo.held_elsewhere(T, F.col("b")), "t string, b string") == [True, False]


def test_normalize(run):
    assert run(["Đại  Nhạc-Hội!", "é đ", None, "ß œ"], text.normalize(T)) == ["dai nhac hoi", "e d", "", ""]
    assert run(["Khai mạc Lễ hội Ok Om Bok"], text.keyword_hits(T))[0] == ["le hoi", "ok om bok", "khai mac"]
    again = text.normalize(text.normalize(T))
    assert run(["Ẩm Thực; Việt"], again) == run(["Ẩm Thực; Việt"], text.normalize(T))


def test_titles_and_names(run):
    assert run(["Ảnh: Lễ hội", "Một tiêu đề dài hơn bốn mươi ký tự cho chắc - Báo Mới", "ngắn - A"], text.clean_title(T)) == ["Lễ hội", "Một tiêu đề dài hơn bốn mươi ký tự cho chắc", "ngắn - A"]
    assert run(["Hoàn tất công tác chuẩn bị cho lễ hội hoa xuân", "Hội hoa trước ngày 5/11", "ngắn"], text.canonical_name(T)) == ["Lễ hội hoa xuân", "Hội hoa trước ngày 5/11", "ngắn"]
    cases = {"Khai mạc Lễ hội Trái cây năm 2026 tại Bến Tre": "Lễ hội Trái cây năm 2026", "Đêm nhạc thuộc Festival Hoa lần thứ 3 thu hút khách": "Festival Hoa lần thứ 3", "Sôi động Ok Om Bok": "Lễ hội Ok Om Bok", "Tin giao thông": "", "Ngày hội “Sắc màu quê hương” ở Cần Thơ": "Ngày hội Sắc màu quê hương", "Mekong Delta Marathon 2026 khởi tranh": "Mekong Delta Marathon 2026", "Lễ hội lớn nhất năm": ""}
    assert run(cases, names.event_name_of(T, F.lit(""))) == list(cases.values())


def test_summary_messages_commands(run):
    long = "Câu mở đầu. Đây là một câu đủ dài để làm phần tóm tắt cho tin này. Hết."
    assert run([long, "ngắn", None], text.make_summary(T)) == ["Đây là một câu đủ dài để làm phần tóm tắt cho tin này.", "ngắn", ""]
    blocks = ["\n\n".join("y" * 700 for _ in range(12)), "z" * 9000, "a\n\nb", "w" * 3900 + "\n\n" + "v" * 3900]
    for whole, parts in zip(blocks, run(blocks, text.split_message(T)), strict=True):
        assert all(len(p) <= 3900 for p in parts) and "".join(parts).replace("\n", "") == whole.replace("\n", "")
    got = run(["/Tinh@bot Cần Thơ ", "xin chào", "/help"], text.parsed_command(T))
    assert [(r.cmd, r.arg) for r in got] == [("tinh", "Cần Thơ"), ("", "xin chào"), ("help", "")]
    assert run(["08:15, 04/10/2026 mở hội 5/11"], text.strip_stamps(T)) == ["  mở hội 5/11"]
    assert run(["La fête de la musique à Paris cet été", "Lễ hội mùa xuân ở phương Nam năm nay", "short"], text.not_vietnamese(T)) == [True, False, False]
    assert run([("Bản tin tối", ""), ("Tin", "https://x.vn/a/thoi-su-19h"), ("Tin", "https://x.vn/a")], text.is_bulletin(T, F.col("u")), "t string, u string") == [True, True, False]


def test_priority(run):
    args = (F.col("n"), F.lit(""), F.col("c"), F.col("f"), F.lit(False))
    cases = [("Lễ hội A", 15000, False), ("Hội chợ B", None, False), ("Gặp mặt nhỏ", None, False), ("Đêm nhạc C", None, True), ("Hội ở Quảng trường", 6000, False), ("Lễ Vu Lan", None, False), ("Họp dân", 1200, False)]
    assert run(cases, facts.priority(*args), "n string, c int, f boolean") == ["CAO", "TB", "THAP", "CAO", "CAO", "TB", "TB"]


def test_ranges(run):
    cases = [(d("2026-11-05"), d("2026-11-07")), (d("2026-11-28"), d("2026-12-02")), (d("2026-11-05"), None), (None, None)]
    assert run(cases, render.date_range(F.col("a"), F.col("b")), "a date, b date") == ["5–7/11", "28/11–2/12", "5/11", render.NO_DATE]
    assert run([(12345,)], render.number(F.col("n")), "n int") == ["12.345"]


def test_lists_are_consistent():
    assert len(lexicon.PROVINCES) == 8 and lexicon.ELSEWHERE.count("kon tum") == 2
    assert all(geo._SHOWN[shown] == names.fold(shown) for shown, _ in lexicon.PROVINCES.values())


def test_a_word_is_folded_once():
    names._code.cache_clear()
    words = "Lễ chùa Khu1 tại Cần Thơ"
    assert names.typed_name(words) == names.typed_name(words) == ""
    told = names._code.cache_info()
    assert told.misses == 6 and told.hits == 6
    assert [names._code(w) for w in ("“Hội", "-", "Khu1,", "2026")] == ["“hoi", "–·", "khu1#,", "2026"]


def test_dates_of_two_days_are_found_by_any_of_their_marks(run):
    cases = {"20/6-23/6": (20, 23), "10.6–12.6": (10, 12), "5 ĐẾN 7/6": (5, 7), "5 và 7 tháng 6": (5, 7), "5/6 tới ngày 9/6": (5, 9), "lúc 3.5 điểm, 8/6": (8, 8)}
    found = run([*cases], dates.find_dates(F.col("t"), F.lit(date(2026, 6, 1))))
    assert [[(s.start.day, s.end.day) for s in spans] for spans in found] == [[v] for v in cases.values()]
