"""Token files, archives and mixing: exact round trips and brute force on small tables."""

import base64
import hashlib
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.common import materialise, scratch_dir
from tidemark.llm.files import Appender, open_folder, read_ranges
from tidemark.llm.mixing import poisson_mix
from tidemark.llm.token_files import Encoder, read_token_files, token_round_trip, with_start, write_token_files
from tidemark.llm.warc import archive_round_trip, read_archives, write_archives

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, " ", "one", "two words", "  lead and  double ", "tab\there\nline\r\n\nnext", "don't 's I'll x2 3y", "é è　ü   z", "<|endoftext|> in text", "a <|endoftext|> b", "é<|endoftext|>é<|endof", "日本語 のテキスト ok",
    "x" * 5000, "word " * 3000, "\x1codd \x1c sign", "ªº x² ǅ áb",
]


def ids_of(text):
    tok = Tokenizer.from_file(PATH)
    return tok.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_encoder_gives_the_ids_of_whole_texts():
    import pyarrow as pa

    texts = [t or "" for t in TEXTS]
    for _ in range(2):  # the second time from the table of words
        ids, at = Encoder(PATH).batch(pa.array(texts), 2)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == ids_of(t), t


def test_token_files_round_trip(spark):
    rows = [(None if i == 3 else i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(7, "again", "x", 0), (7, "again", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, shard int")
    got = token_round_trip(spark, docs, scratch_dir(spark, "t"), PATH).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expect = 0, []
    for r in order:
        ids = ids_of(r[1])
        expect.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(expect, key=str)


def test_one_document_is_read_alone_and_dictionaries_are_checked(spark):
    docs = spark.createDataFrame([(i, f"some text {i} " * (i + 1)) for i in range(200)], "doc_id long, text string")
    folder = scratch_dir(spark, "t")
    index = write_token_files(docs, folder, PATH, file_bytes=2000)
    assert index.select("file").distinct().count() > 1
    got = read_token_files(with_start(index).where("doc_id = 77"), folder).collect()
    assert [list(r["ids"]) for r in got] == [ids_of("some text 77 " * 78)]
    fs, path = open_folder(folder)
    name = next(x for x in fs.get_file_info(__import__("pyarrow").fs.FileSelector(path)) if x.path.endswith(".dict"))
    with fs.open_output_stream(name.path) as out:
        out.write(b"other")
    with pytest.raises(Exception, match="another dictionary"):
        read_token_files(index, folder).collect()


def test_token_files_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_round_trip(spark, docs, scratch_dir(spark, "t"), PATH).collect() == []


def test_ranges_are_coalesced_and_exact(tmp_path):
    out = Appender(str(tmp_path), "a", ".bin", 50)
    blobs = [bytes([i]) * (i % 7 + 1) for i in range(60)]
    at = [(*out.add(b), len(b)) for b in blobs]
    out.close()
    assert len({x[0] for x in at}) > 1
    assert list(read_ranges(str(tmp_path), at)) == blobs
    assert list(read_ranges(str(tmp_path), at[::-1], gap=0, most=10)) == blobs[::-1]
    assert list(read_ranges(str(tmp_path), [])) == []


PAGES = [
    (1, "http://a.org/x", "<p>same</p>", "k"), (2, "http://a.org/y", "<p>same</p>", "k"), (5, None, "<p>same</p>", "k"), (3, "http://b.org/\r\nü x", None, "k"), (4, "u", "", "k"),
    (6, "u", "line\r\n\r\nWARC/1.1\r\n\r\nlike", "k"), (None, "u", "<p>same</p>", "k"), (None, "v", "alone", "k"), (7, "w", "é" * 100_000, "k"), (5, None, "<p>same</p>", "k"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")


def test_archives_round_trip(spark):
    got = archive_round_trip(spark, pages(spark), scratch_dir(spark, "w")).collect()
    expect = []
    for page, _, html, _ in PAGES:
        body = (html or "").encode()
        ids = [p for p, _, h, _ in PAGES if (h or "").encode() == body]
        keep = max((i for i in ids if i is not None), default=None)
        response = len(ids) == 1 or keep is None or page == keep
        expect.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else keep))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(expect, key=str)


def test_selected_records_come_with_their_payload(spark):
    folder = scratch_dir(spark, "w")
    index = write_archives(pages(spark), folder, archive_bytes=300)
    assert index.select("file").distinct().count() > 1
    got = read_archives(index.where("page_id in (6, 7)"), folder).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got} == {6: PAGES[5][2], 7: "é" * 100_000}
    whole = write_archives(pages(spark), scratch_dir(spark, "w"), min_dedup_bytes=1 << 20)
    assert {r["record_type"] for r in whole.collect()} == {"response"}
    assert write_archives(pages(spark).limit(0), scratch_dir(spark, "w")).count() == 0


def test_mixture_is_the_inverse_of_the_poisson_distribution(spark):
    import math

    rows = [(i, "t" * (i % 9), "a" if i % 3 else "b", i) for i in range(600)] + [(None, "tt", None, 0), (1, "tt", None, 0), (2, None, "c", 1), (2, None, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, table int")
    got = poisson_mix(docs, {"a": 1.0, "b": 5.0, None or "zz": 3.0}, default_weight=2.0, epochs=1.5, seed="s").collect()
    size, weight = {}, {"a": 1.0, "b": 5.0}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(t or "")
    every, total = sum(size.values()), sum(weight.get(s, 2.0) for s in size if size[s])
    expect = {}
    for d, t, s, x in rows:
        rate = 1.5 * every * weight.get(s, 2.0) / total / size[s] if size[s] else 0.0
        u = (int(hashlib.md5(f"s|{'' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p = 0, math.exp(-rate)
        left = p
        while left < u:
            n += 1
            p *= rate / n
            left += p
        for c in range(1, n + 1):
            k = (d, t, s, x, c)
            expect[k] = expect.get(k, 0) + 1
    seen = {}
    for r in got:
        k = (r["doc_id"], r["text"], r["source"], r["table"], r["copy_no"])
        seen[k] = seen.get(k, 0) + 1
    assert seen == expect
    assert len({r["mix_order"] for r in got}) > 100
    assert poisson_mix(docs.limit(0), {}).collect() == []


def test_mixture_reaches_its_target_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 50) as text", "if(id % 10 < 7, 'hot', 'cold') as source")
    got = {r["source"]: r["n"] for r in materialise(poisson_mix(docs, {"hot": 1.0, "cold": 1.0}), "m").groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert abs(got["hot"] - 10_000) < 400 and abs(got["cold"] - 10_000) < 400


def test_rates_of_any_size(spark):
    """A tiny source with a large share repeats very often; its counts keep mean and spread."""
    import math

    rows = [(i, "x" * 2000, "large") for i in range(1000)] + [(10_000 + i, "x", "tiny") for i in range(40)]
    got = poisson_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"tiny": 0.02, "large": 0.98})
    n = [r["n"] for r in got.where("source = 'tiny'").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()]
    rate = 0.02 * (2_000_000 + 40) / 40
    assert len(n) == 40 and abs(sum(n) / 40 - rate) < 5 * math.sqrt(rate / 40)
    assert 0.5 * math.sqrt(rate) < (sum((x - rate) ** 2 for x in n) / 40) ** 0.5 < 1.6 * math.sqrt(rate)
