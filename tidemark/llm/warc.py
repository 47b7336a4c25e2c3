"""WARC archives with an index that is written first and read first.

``write_archives`` writes one gzip member per record and returns the index: file, offset, length, URL and digest of every
record.  ``read_archives`` takes any selection of index rows, sorts them by place and fetches neighbours with one read.
Records with equal payloads are stored once: the one with the largest id is the response, the others are revisits.

Defined cases: a null html is an empty payload; a null URL writes no target header; null ids are allowed, and lose to any
id (if all are null, each is a response); rows that repeat the winning id and payload are all responses; an empty table
gives an empty index; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, materialise
from tidemark.llm.files import Appender, read_ranges

INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
# fixed values: the archive format's version line and field names
VERSION = b"WARC/1.1"
TYPE, RECORD_ID, DATE, TARGET, DIGEST, REFERS = "WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str):
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def encode_record(page_id, url, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One record as a gzip member of its own."""
    import gzip
    from urllib.parse import quote

    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    fields = {TYPE: "revisit" if revisit else "response", RECORD_ID: _urn(page_id), DATE: date}
    if url is not None:
        fields[TARGET] = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
    fields[DIGEST] = f"sha1:{digest}"
    if revisit:
        fields |= {REFERS: _urn(refers_to), "WARC-Profile": PROFILE}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 4, mtime=0)


def decode_record(blob: bytes) -> dict:
    """A record read back; the digest of a stored payload is checked."""
    import gzip

    head, _, rest = gzip.decompress(blob).partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not an archive record: {lines[0][:40]!r}")
    fields = dict(x.decode().split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b": ")[2])
    digest = fields[DIGEST].removeprefix("sha1:")
    revisit = fields[TYPE] == "revisit"
    if not revisit and (len(payload) != size or base32_digest(payload) != digest):
        raise ValueError(f"payload of {fields[RECORD_ID]} differs from its digest")
    return {
        "page_id": _page(fields[RECORD_ID]), "url": fields.get(TARGET), "payload_bytes": size, "payload_digest": digest, "record_type": fields[TYPE],
        "refers_to": _page(fields[REFERS]) if revisit else None, "payload": None if revisit else payload,
    }


def write_archives(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_dedup_bytes: int = 0, archive_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write every page as a record below ``folder`` and return the index as a table of the shared scratch folder.

    Only digests are grouped; the groups of more than one page are written down first, so that their real size decides
    how they are joined back, and a digest with very many copies is split by the adaptive join.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("body")
    ).withColumns({"sha": F.sha1("body"), "size": F.octet_length("body").cast("long")})
    shared = rows.where(F.col("size") >= min_dedup_bytes).groupBy(F.col("sha").alias("d_sha"), F.col("size").alias("d_size")).agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    shared = materialise(shared.where("n > 1 and keep is not null").drop("n"), "warc-shared")
    rows = rows.join(shared, (F.col("sha") == F.col("d_sha")) & (F.col("size") == F.col("d_size")), "left")
    rows = rows.withColumn("refers", F.when(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))
    rows = rows.select("page_id", "url", F.when(F.col("refers").isNull(), F.col("body")).alias("body"), "sha", "size", "refers")

    def write(batches):
        import base64

        import pyarrow as pa
        from pyspark import TaskContext

        out = Appender(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc.gz", archive_bytes)
        try:
            for batch in batches:
                got = []
                for x in batch.to_pylist():
                    digest = base64.b32encode(bytes.fromhex(x["sha"])).decode()
                    blob = encode_record(x["page_id"], x["url"], x["body"] or b"", digest, x["size"], x["refers"], date)
                    file, at = out.add(blob)
                    got.append((x["page_id"], x["url"], digest, x["size"], "response" if x["refers"] is None else "revisit", x["refers"], file, at, len(blob)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types(pa), strict=True)] if got else [pa.array([], t) for t in types(pa)], names=names)
        finally:
            out.close()

    names = [x.split()[0] for x in INDEX.split(", ")]

    def types(pa):
        return [pa.int64() if x.split()[1] == "long" else pa.string() for x in INDEX.split(", ")]

    return materialise(bounded_batches(rows, 256).mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str, *, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows; sorted by place, so that near records share a read."""
    index = index.select("file", "offset", "length").sortWithinPartitions("file", "offset")

    def read(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])
        for batch in batches:
            got = []
            for blob in read_ranges(folder, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                record = decode_record(blob)
                got.append(record if with_payload else record | {"payload": None})
                if len(got) >= 256:
                    yield pa.RecordBatch.from_pylist(got, schema)
                    got = []
            yield pa.RecordBatch.from_pylist(got, schema)

    return index.mapInArrow(read, RECORD)


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str, **options) -> DataFrame:
    index = write_archives(pages, folder, **options)
    return read_archives(index, folder, with_payload=False).drop("payload")
