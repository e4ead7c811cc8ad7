"""Articles, events and source runs derived from general tables, in SQL that Spark and DuckDB both read.

The domain's own data is not at hand here; these views give every operator rows to work on, at any scale, and let
DuckDB compute the same results from the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The day that all queries take as today.
TODAY = "1996-06-15"

_PLACES = ("TP.HCM", "Đồng Nai", "Tây Ninh", "An Giang", "Đồng Tháp", "Vĩnh Long", "Cần Thơ", "Cà Mau", "Hà Nội", "Đà Nẵng")
_KEYS = ("hcm", "dongnai", "tayninh", "angiang", "dongthap", "vinhlong", "cantho", "camau")
_KINDS = ("Lễ hội", "Hội chợ", "Triển lãm", "Tai nạn", "Khai mạc", "Đại nhạc hội", "Giải chạy", "Chuẩn bị Lễ hội")


def _choose(number: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


_DAY = "CAST(o_orderdate AS DATE)"
_DATE = f"CAST(extract(day FROM {_DAY}) AS STRING) || '/' || CAST(extract(month FROM {_DAY}) AS STRING)"
_NAME = f"{_choose('o_orderkey', _KINDS)} || ' ' || c_mktsegment || ' Khu' || CAST(o_custkey % 97 AS STRING)"
_PLACE = _choose("c_nationkey", _PLACES)
_CROWD = "CAST(floor(o_totalprice / 10) AS INT)"

ARTICLES = f"""
SELECT o_orderkey AS item_id, 'https://tin.example/' || CAST(o_orderkey AS STRING) || '.html' AS link,
       {_NAME} || ' tại ' || {_PLACE} || ' ngày ' || {_DATE} AS title, '' AS summary,
       'Sự kiện diễn ra lúc ' || CAST(8 + o_orderkey % 12 AS STRING) || 'h30 ngày ' || {_DATE} || ' tại Quảng trường Sao Mai, dự kiến '
       || CAST({_CROWD} AS STRING) || ' người tham dự, ' || CASE WHEN o_orderkey % 5 = 0 THEN 'có bắn pháo hoa' ELSE 'không bắn pháo hoa' END
       || '. Ban tổ chức cho biết mọi việc đã sẵn sàng.' AS body,
       {_DAY} AS published, {_choose('c_nationkey', _KEYS)} AS province_hint, false AS is_search, o_orderkey % 3 = 0 AS trust_hint,
       o_orderkey % 5 = 0 AS expected_fireworks, {_CROWD} AS expected_crowd, 8 + o_orderkey % 12 AS expected_hour
FROM orders JOIN customer ON o_custkey = c_custkey
"""

EVENTS = f"""
SELECT o_orderkey AS id, {_NAME} AS name, {_choose('c_nationkey', _KEYS)} AS province,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Quảng trường Sao Mai' END AS venue,
       CASE WHEN o_orderkey % 50 = 7 THEN CAST(NULL AS DATE) ELSE {_DAY} END AS start_date,
       CASE WHEN o_orderkey % 50 = 7 THEN CAST(NULL AS DATE) ELSE CAST({_DAY} + CAST(o_orderkey % 5 AS INT) AS DATE) END AS end_date,
       CASE WHEN o_orderkey % 3 = 0 THEN '19:30' ELSE '' END AS start_time,
       CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS INT) ELSE {_CROWD} END AS crowd,
       o_orderkey % 97 = 0 AS fireworks, o_orderkey % 101 = 0 AS big_concert,
       'Sự kiện thường niên tại ' || {_PLACE} AS summary, o_orderkey % 11 = 0 AS alerted,
       'https://tin.example/' || CAST(o_orderkey AS STRING) || '.html' AS source, {_DAY} AS first_seen
FROM orders JOIN customer ON o_custkey = c_custkey
"""

RUNS = """
SELECT 'source' || CAST(user_id % 200 AS STRING) AS source_id, event_id AS seq, ts AS run_at, event_type <> 'error' AS ok,
       CASE WHEN event_type = 'error' THEN 'HTTP 503 https://x.example/' || CAST(event_id AS STRING) END AS error
FROM events
"""

LEDGER = """
SELECT 'https://tin.example/' || CAST(user_id * 7 % 5000 AS STRING) || '.html' AS link, event_type AS status, ts AS seen_at, event_id
FROM events
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task of the rules takes.
PART_ROWS = 25_000


def spread(df: DataFrame, scanned: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` over all cores, if what it is made from was read in fewer parts: rules cost far more than moving short rows.

    With ``key``, its rows are short and dealt by it into parts of about ``PART_ROWS``: a join's result comes in parts by
    bytes, so few parts would hold many rows, and one task would grow with the table. The count reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if key:
        return df.repartition(max(cores, -(-scanned.count() // PART_ROWS)), key)
    return df if scanned.rdd.getNumPartitions() >= cores else df.repartition(cores)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the statements above over the tables of ``sf_dir``."""
    used = {n: _table(spark, sf_dir, n) for n in ("orders", "customer", "events") if f" {n}" in sql}
    for n, df in used.items():
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **used)
