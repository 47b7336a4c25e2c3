"""The driver tables seen as timed segments, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import wide_class
from tidemark.functions.timecode import epoch_ms
from tidemark.operators.ordered import Order, chunked, running

# fixed values: the Unicode white-space characters, for RE2
WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
HOUR = 3_600_000
DAY = 24 * HOUR
# 2024-01-01 in epoch milliseconds: event times count from here, like stream time counts from 0
EPOCH = 1_704_067_200_000
MONTH = 31 * DAY
CHUNK = 6 * DAY
EV_ORDER = Order()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as intervals: three minutes per unit of value, one stream per user."""
    start = epoch_ms(F.col("ts")) - EPOCH
    return table(spark, sf, "events").select(
        F.col("user_id").alias("stream_id"),
        F.col("event_id").alias("seq"),
        start.alias("start_ms"),
        (start + F.round(F.col("value") * 180_000).cast("long")).alias("end_ms"),
        F.col("event_type").alias("family"),
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.concat_ws(" ", "event_type", (F.regexp_extract("props", r"(\d+)", 1).cast("long") % 4).cast("string")).alias("text"),
    )


EV = """ev AS (
  SELECT user_id AS stream_id, event_id AS seq, epoch_us(ts) // 1000 - 1704067200000 AS start_ms,
         epoch_us(ts) // 1000 - 1704067200000 + CAST(round(value * 180000) AS BIGINT) AS end_ms,
         event_type AS family, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents,
         event_type || ' ' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS VARCHAR) AS text
  FROM events)"""


def chunked_events(df: DataFrame) -> tuple[DataFrame, Order]:
    return chunked(df, EV_ORDER, CHUNK)


LINE_ORDER = Order(by=("seq",))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines as segments; a document is one row, so a stream is bounded by row size."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("stream_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text")
    )
    docs = docs.withColumn("seq", F.col("seq").cast("long") + 1)
    docs = running(docs, LINE_ORDER, {"_off": ("sum", F.length("text").cast("long") + 1)})
    start = F.col("_off") * 50
    return docs.select(
        "stream_id", "seq", start.alias("start_ms"),
        (start + F.length("text") * 40 + F.col("seq") % 11 * 100).alias("end_ms"), "text",
    )


LN = """raw AS (
  SELECT doc_id AS stream_id, unnest(string_split(text, chr(10))) AS text,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS seq FROM documents),
off AS (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY stream_id ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM raw),
ln AS (
  SELECT stream_id, seq, CAST(o * 50 AS BIGINT) AS start_ms,
         CAST(o * 50 + length(text) * 40 + seq % 11 * 100 AS BIGINT) AS end_ms, text FROM off)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns; 60 ms per character, a pause that depends on the turn."""
    df = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text"
    )
    df, order = chunked(df, Order(by=("seq",)), 4)
    width = F.length("text").cast("long") * 60
    df = running(df, order, {"_off": ("sum", width + F.col("seq") % 4 * 2000)})
    return df.select("stream_id", "seq", "speaker", F.col("_off").alias("start_ms"), (F.col("_off") + width).alias("end_ms"), "text")


TN = """tn AS (
  SELECT conv_id AS stream_id, turn AS seq, role AS speaker,
         CAST(coalesce(sum(length(text) * 60 + turn % 4 * 2000) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
         CAST(coalesce(sum(length(text) * 60 + turn % 4 * 2000) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) * 60 AS BIGINT) AS end_ms,
         text FROM conversations)"""


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def sql_width(c: str) -> str:
    """Wide, full-width and ambiguous characters count one, other visible ones half."""
    return f"(length({sql_compact(c)}) + length(regexp_replace({sql_compact(c)}, '[^{wide_class()[1:]}', '', 'g'))) * 0.5"


def sql_compact(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+', '', 'g')"


def sql_key(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def sql_bigrams(c: str) -> str:
    return (
        f"CASE WHEN length({c}) < 2 THEN [{c}] ELSE "
        f"list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) END"
    )


def sql_jaccard(a: str, b: str) -> str:
    x, y = sql_bigrams(a), sql_bigrams(b)
    return f"(CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len(list_distinct(list_concat({x}, {y}))))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
