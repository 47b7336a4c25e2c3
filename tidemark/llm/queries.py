"""Registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, scratch_dir, table
from tidemark.llm.conversations import damaged, repair_conversations
from tidemark.llm.decontaminate import benchmark_hits
from tidemark.llm.heap_kmeans import cluster_report, heap_kmeans
from tidemark.llm.jaccard_join import Rule, jaccard_groups
from tidemark.llm.language import predict_language, train_language_filter
from tidemark.llm.mixing import poisson_mix
from tidemark.llm.sql import JACCARD_SQL, KMEANS_SQL, REPAIR_SQL, URL_SQL, WARC_SQL
from tidemark.llm.surrogates import replace_entities
from tidemark.llm.token_files import token_round_trip
from tidemark.llm.topk import exact_top_k
from tidemark.llm.toxicity import score_toxicity, train_toxicity
from tidemark.llm.url_filter import judge_urls
from tidemark.llm.warc import archive_round_trip
from tidemark.llm.wrapper import extract_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: a busy source gets about a quarter of the mixture, the others share the rest evenly
MIX_WEIGHTS = {"src0": 6.0}
MIX = {"default_weight": 1.0, "epochs": 1.0, "seed": "mix-1"}
END_ID = 2
#: a deployment passes its own
SURROGATE_KEY = "surrogates-1"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_token_files")
def token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_round_trip(spark, table(spark, sf, "documents"), scratch_dir(spark, "token-files"), tokenizer_path(), end_id=END_ID)


@query("op10_warc_index", WARC_SQL)
def warc_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = archive_round_trip(spark, table(spark, sf, "pages"), scratch_dir(spark, "warc"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


MIX_SQL = """
WITH sized AS (SELECT source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY source),
weighed AS (SELECT source, chars, CASE WHEN chars <= 0 THEN 0.0::DOUBLE WHEN source = 'src0' THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sized),
rated AS (SELECT source, CASE WHEN chars > 0 THEN (SELECT sum(chars) FROM weighed)::DOUBLE * weight / (SELECT sum(weight) FROM weighed) / chars ELSE 0.0 END AS rate FROM weighed),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rated WHERE rate > 0),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - CASE WHEN k < 2 THEN 0.0 ELSE lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(cs, lambda c: c < (('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5) / 4503599627370496)) AS n
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy_no FROM drawn WHERE n > 0)
SELECT *, (('0x' || substr(md5('mix-1/order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy_no), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS mix_order
FROM copies"""


@query("op9_poisson_mix", MIX_SQL)
def mix(spark: SparkSession, sf: str) -> DataFrame:
    return poisson_mix(table(spark, sf, "documents"), MIX_WEIGHTS, **MIX)


TOPK_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op7_ball_tree_top_k", TOPK_SQL)
def ball_tree_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return exact_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


@query("op3_language_filter")
def language_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = crc_mod(F.col("doc_id"), 4)
    model = train_language_filter(docs.where(part != 2), train_docs=1500)
    return predict_language(docs, model, [F.col("doc_id"), part == 2]).toDF("doc_id", "held_out", "lang_pred", "score")


@query("op6_toxicity_trees")
def toxicity_trees(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = train_toxicity(docs, table(spark, sf, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return score_toxicity(docs, model, [F.col("doc_id"), crc_mod(F.col("doc_id"), 3) == 1], ["doc_id", "held_out"])


@query("op2_jaccard_groups", JACCARD_SQL)
def jaccard_join_groups(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_groups(table(spark, sf, "documents"), Rule(width=3, num=90, den=100))


@query("op5_benchmark_hits")
def hits(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), width=5, least=0.8)


@query("op1_wrapper_text")
def wrapper_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(table(spark, sf, "pages"))


@query("op4_surrogates")
def surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return replace_entities(table(spark, sf, "documents").select("doc_id", "text"), SURROGATE_KEY)


@query("op11_url_verdicts", URL_SQL)
def url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(table(spark, sf, "pages"), URL_RULES)


@query("op12_heap_kmeans", KMEANS_SQL)
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    assigned, centroids, _ = heap_kmeans(table(spark, sf, "embeddings"), dims=64, k=16, rounds=3, scale=64.0, seed="1")
    return cluster_report(assigned, centroids)


@query("op13_repair_conversations", REPAIR_SQL)
def repaired(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return repair_conversations(rows, damaged(rows))
