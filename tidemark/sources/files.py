"""Scans and sinks for timed-text files, JSON lines, CSV and file inventories.

Scans read a folder of files or, with ``packed``, a table of them: many small files as rows of a few large Parquet files, with the columns
of Spark's own binaryFile scan.  A folder costs a create, a rename, a listing and an open for each file, and its list passes the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import WS
from tidemark.functions.timecode import from_ms, to_ms

# fixed values: text encodings tried in order after a byte-order mark
FALLBACK_ENCODINGS = ("utf-8-sig", "utf-8", "cp932", "shift_jis", "cp949", "euc-kr")
ARROW = r"^\s*(\S+)\s+-->\s+(\S+)"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode_text(content: pd.Series) -> pd.DataFrame:
    """Bytes to text through the fallback encodings; replacement characters as the last resort."""
    def one(raw):
        raw = bytes(raw)
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return raw.decode("utf-16", errors="replace"), "utf-16"
        for name in FALLBACK_ENCODINGS:
            if name == "utf-8-sig" and not raw.startswith(b"\xef\xbb\xbf"):
                continue
            try:
                return raw.decode(name), name
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", errors="replace"), "replaced"

    return pd.DataFrame([one(c) for c in content], columns=["text", "encoding"])


PACKED = "path string, modificationTime timestamp, length long, content binary"


def pack_files(members: DataFrame, path: str) -> None:
    """SNK1 (packed): ``members`` (``name`` below ``path``, ``content``) as one table of files."""
    content = F.col("content").cast("binary")
    files = members.select(F.concat(F.lit(f"{path}/"), "name").alias("path"), F.current_timestamp().alias("modificationTime"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    files.write.mode("errorifexists").parquet(path)


def read_files(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """``path, modificationTime, length, content`` of every file below a folder or in a table of files."""
    if packed:
        return spark.read.schema(PACKED).parquet(path)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def parse_blocks(files: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """Blocks of timed-text files: one row per block, ``reason`` set where it is malformed.

    A file is one row, so its blocks explode where it was read and nothing shuffles.  The lenient
    flavour drops blocks without an arrow, takes short clocks and leaves the number optional.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), r"\r\n?", "\n")
    parts = F.filter(F.split(body, r"\n[ \t]*\n+"), lambda b: ~b.rlike(rf"^{WS}*$"))
    rows = files.select(*[c for c in files.columns if c != text], F.posexplode(parts).alias("block_no", "_b"))
    lines = F.split(F.regexp_replace("_b", r"^\n+", ""), "\n")
    rows = rows.withColumn("_l", lines)
    first, second = F.trim(F.get("_l", 0)), F.trim(F.coalesce(F.get("_l", 1), F.lit("")))
    numbered = first.rlike(r"^\d+$")
    clock = second if strict else F.when(first.contains("-->"), first).otherwise(second)
    skip = F.lit(3) if strict else F.when(first.contains("-->"), 2).otherwise(3)
    rest = F.slice("_l", skip, F.greatest(F.size("_l") - skip + 1, F.lit(0)))
    start, end = to_ms(F.regexp_extract(clock, ARROW, 1), strict), to_ms(F.regexp_extract(clock, ARROW, 2), strict)
    reason = (
        F.when(F.lit(strict) & (F.size("_l") < 2), "too_few_lines").when(F.lit(strict) & ~numbered, "bad_number")
        .when(~clock.contains("-->"), "no_arrow").when(start.isNull() | end.isNull(), "bad_timecode")
    )
    edge = rf"^{WS}+|{WS}+$"
    out = rows.select(
        *[c for c in files.columns if c != text], (F.col("block_no") + 1).cast("long").alias("block_no"),
        F.when(numbered, first).try_cast("long").alias("seq"), start.alias("start_ms"), end.alias("end_ms"),
        F.regexp_replace(F.array_join(rest, "\n"), edge, "").alias("text"), reason.alias("reason"), F.col("_b").alias("raw"),
    )
    return out if strict else out.where(~F.col("reason").eqNullSafe(F.lit("no_arrow")))


def scan_timed_text(spark: SparkSession, path: str, strict: bool = True, legacy: bool = False, packed: bool = False) -> DataFrame:
    """SRC1: every block of every file below ``path`` in one job, with its file and (from a folder) partition columns."""
    if legacy:
        raw = read_files(spark, path, packed).select(F.col("path").alias("file"), decode_text("content").alias("d"))
        raw = raw.select("file", "d.encoding", F.col("d.text").alias("text"))
    elif packed:
        raw = read_files(spark, path, packed).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    else:
        raw = spark.read.text(path, wholetext=True)
        cols = [c for c in raw.columns if c != "value"]
        raw = raw.select(*cols, F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_blocks(raw, strict=strict)


def good_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where("reason is null").drop("reason", "raw")


def quarantine(blocks: DataFrame) -> DataFrame:
    return blocks.where("reason is not null").select("file", "block_no", "reason", "raw")


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC2: JSON lines with bad rows kept apart: blank lines skipped, BOM dropped, ``bad_row`` holds rejects."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v"), F.col("_metadata.file_path").alias("file"))
    lines = lines.where(~F.col("v").rlike(rf"^{WS}*$"))
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("j", F.from_json("v", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    # the reader stops after the first object; inside brackets anything after it is an error
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("v"), F.lit("]")))
    lone = whole.isNotNull() & F.try_variant_get(whole, "$[1]", "string").isNull()
    objects = F.col("v").rlike(rf"^{WS}*\{{") & lone
    bad = F.when(~objects | F.col("j").isNull() | F.col("j._bad").isNotNull(), F.col("v"))
    return parsed.select("file", *[F.when(bad.isNull(), F.col(f"j.{f.name}")).alias(f.name) for f in schema.fields], bad.alias("bad_row"))


def scan_csv(spark: SparkSession, path: str, required: Sequence[str], defaults: Mapping[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """SRC3: text columns of CSV files; missing required columns are an error, missing others get defaults.

    ``multi_line`` reads quoted line breaks, at the price of one task for each file.
    """
    df = spark.read.option("header", "true").option("multiLine", multi_line).option("escape", '"').csv(path)
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def role_of(path: Column, roles: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(roles)):
        out = F.when(path.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def file_manifest(
    spark: SparkSession, path: str, roles: Sequence[tuple[str, str]], stream_pattern: str, text_roles: Sequence[str] | None = None, digest: bool = True,
    packed: bool = False,
) -> DataFrame:
    """SRC4: role, digest, size, time, encoding, block count and first/last clock of each file.

    Roles come from names alone.  Only files of ``text_roles`` (all roles, if not given) are decoded; files with another role or none are
    listed from their metadata, and with ``digest=False`` no byte of them is read.
    """
    files = read_files(spark, path, packed)
    stream, role = F.regexp_extract("path", stream_pattern, 1).alias("stream_id"), role_of(F.col("path"), roles).alias("role")
    named = files.withColumn("_role", role)
    wanted = F.col("_role").isin(list(text_roles if text_roles is not None else [name for name, _ in roles]))
    raw = named.where(wanted).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), decode_text("content").alias("d"),
    )
    text = F.regexp_replace("d.text", r"\r\n?", "\n")
    clocks = F.regexp_extract_all(text, F.lit(r"(\d{2,}:\d{2}:\d{2},\d{3})\s+-->"), 1)
    ends = F.regexp_extract_all(text, F.lit(r"-->\s+(\d{2,}:\d{2}:\d{2},\d{3})"), 1)
    texts = raw.select(
        "path", stream, role, "size", "modified", "sha256", F.col("d.encoding").alias("encoding"),
        F.size(clocks).alias("blocks"), F.get(clocks, 0).alias("first_clock"), F.get(ends, F.size(ends) - 1).alias("last_clock"),
    )
    none = F.lit(None).cast("string")
    sha = F.sha2("content", 256) if digest else none
    others = named.where(~F.coalesce(wanted, F.lit(False))).select(
        "path", stream, role, F.col("length").alias("size"), F.col("modificationTime").alias("modified"), sha.alias("sha256"), none.alias("encoding"),
        F.lit(None).cast("int").alias("blocks"), none.alias("first_clock"), none.alias("last_clock"),
    )
    return texts.unionByName(others)


def manifest_roles(manifest: DataFrame) -> DataFrame:
    """SRC4 (choice): the file of each role, or ambiguous - never picked - when there are several."""
    out = manifest.where("role is not null").groupBy("stream_id", "role").agg(F.count("*").alias("candidates"), F.min("path").alias("path"))
    return out.withColumns({"ambiguous": F.col("candidates") > 1, "path": F.when(F.col("candidates") == 1, F.col("path"))})


def asset_index(spark: SparkSession, path: str, stream_pattern: str, clock: str = r"_(\d+(?:\.\d+)?)s", packed: bool = False) -> DataFrame:
    """SRC5: assets with the seconds in their name (last match wins), byte-identical copies dropped.

    The earliest (time, path) of a digest stays, found by a partial-aggregated minimum.
    """
    rows = read_files(spark, path, packed).select(
        F.regexp_extract("path", stream_pattern, 1).alias("stream_id"), "path", F.sha2("content", 256).alias("sha"),
        F.regexp_extract_all("path", F.lit(clock), 1).alias("_all"),
    )
    rows = rows.where(F.size("_all") > 0)
    at = F.round(F.get("_all", F.size("_all") - 1).cast("double") * 1000).cast("long")
    first = rows.groupBy("stream_id", "sha").agg(F.min(F.struct(at.alias("at_ms"), "path")).alias("f"))
    return first.select("stream_id", "sha", "f.at_ms", "f.path")


def block_text() -> Column:
    """One rendered block (number, clocks, text, blank line)."""
    return F.concat(
        F.col("seq").cast("string"), F.lit("\n"), from_ms(F.col("start_ms")), F.lit(" --> "), from_ms(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n")
    )


def write_timed_text(df: DataFrame, path: str, stream: str = "stream_id", by: Sequence[str] = ("seq",)) -> None:
    """SNK1: documents below ``stream=<id>/`` as ordered blocks.

    Rows are range-partitioned by (stream, order): a small stream is one file, a very long one
    continues over several files in name order, and no stream is gathered in one row or task.
    """
    rows = df.select(stream, *by, block_text().alias("value")).repartitionByRange(stream, *by).sortWithinPartitions(stream, *by)
    rows.select(stream, "value").write.mode("errorifexists").partitionBy(stream).text(path)


def pack_timed_text(df: DataFrame, path: str, stream: str = "stream_id", by: Sequence[str] = ("seq",), piece: Column | None = None) -> None:
    """SNK1 (packed): the documents of ``write_timed_text`` as members ``stream=<id>/part-<piece>.txt`` of one table of files.

    ``piece`` is a number that grows with the order: a long stream continues over as many members, and no more than a piece is gathered in
    one row.  Without it a stream is one member.
    """
    rows = df.select(stream, *by, (F.lit(0) if piece is None else piece).cast("long").alias("_piece"), block_text().alias("value"))
    blocks = F.array_sort(F.collect_list(F.struct(*by, F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).alias("value"))))
    name = F.format_string(f"{stream}=%s/part-%010d.txt", F.col(stream).cast("string"), F.col("_piece"))
    members = rows.groupBy(stream, "_piece").agg(F.array_join(F.transform(blocks, lambda b: b["value"]), "").alias("content"))
    pack_files(members.select(name.alias("name"), "content"), path)


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """SNK2: a ledger that is never overwritten."""
    writer = df.write.mode("errorifexists").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
