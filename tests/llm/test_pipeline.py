"""The pipeline's stages on the smallest tables, each against a plain version."""

import zlib

import pytest

import corpus_pipeline
from tests.llm.test_files import ids_of
from tests.llm.test_search import plain_groups
from tidemark.llm.common import materialise
from tidemark.llm.jaccard_join import Rule
from tidemark.llm.queries import MIX, MIX_WEIGHTS
from tidemark.llm.mixing import poisson_mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    copy = docs.where("doc_id < 5").selectExpr("doc_id + 100000 as doc_id", "concat(text, ' ') as text", "lang", "source", "n_chars")
    rows = [docs.unionByName(copy).unionByName(docs.where("doc_id = 7")).unionByName(spark.createDataFrame([(None, None, None, None, None), (99999, "", "en", "src1", 0)], docs.schema))]
    rows[0] = materialise(rows[0], "start")
    for name, stage in corpus_pipeline.STAGES:
        rows.append(materialise(stage(spark, rows[-1], SF), "step"))
    return rows


def keyed(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stage_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert steps[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_toxic_documents_go_and_clean_ones_stay(steps):
    before, after = keyed(steps[0]), keyed(steps[1])
    assert set(after) <= set(before) and len(after) >= 0.8 * len(before)


def test_one_document_of_each_group_stays(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    once = list(dict(r for r in rows if r[0] is not None).items())
    keep = {i for i, _, c in plain_groups(once, Rule(5, 80, 100)) if i == c}
    assert sorted(r["doc_id"] for r in steps[2].where("doc_id is not null").collect()) == sorted(keep)
    assert steps[2].where("doc_id is null").count() == steps[1].where("doc_id is null").count()


def test_no_benchmark_item_is_left(steps, spark):
    words = lambda t: " ".join((t or "").lower().split())
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in steps[2].collect() if not any(i in words(r["text"]) for i in items)]
    assert keyed(steps[3]) == sorted(map(tuple, clean), key=str)


def test_mixture_and_token_files(steps):
    assert keyed(steps[4]) == keyed(poisson_mix(steps[3], MIX_WEIGHTS, **MIX).select(*steps[3].columns))
    expect, start = [], 0
    for r in sorted(steps[4].collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = ids_of(r["text"])
        expect.append((r["doc_id"], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert keyed(steps[5]) == sorted(expect, key=str)


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_null_and_repeated_ids_lose_only_rows_that_link_or_hit(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    docs = [(1, text("a")), (2, text("b")), (2, text("c")), (2, text("a") + " end"), (None, text("b") + " end"), (None, text("d")), (None, text("d") + " end"), (3, text("e")), (3, text("e")), (4, ""), (4, "")]
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()
    found = sorted(map(tuple, got), key=str)
    ends = [r for r in found if r in docs[5:7]]
    assert len(ends) == 1 and found == sorted([docs[0], docs[1], docs[2], docs[7], docs[9], docs[10], *ends], key=str)
    docs = [(5, text("a")), (5, item), (None, item), (None, text("b")), (None, None), (6, item), (7, "")]
    got = corpus_pipeline.drop_benchmark(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([docs[0], docs[3], docs[4], docs[6]], key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_to_drop_a_few_of_them(spark):
    """With no side small enough for Spark to broadcast by itself, as over large tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (corpus_pipeline.keep_one_of_each_group, corpus_pipeline.drop_benchmark):
            assert "SortMergeJoin" not in plan_of(stage(spark, docs, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
