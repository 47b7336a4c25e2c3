"""Pipeline stages: each takes (spark, docs, sf_dir) and returns documents, the last one what the token files hold.

All columns of the documents pass through, whatever their names.  Null texts and ids are kept unless a stage's own rule
says otherwise; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, materialise, scratch_dir, table
from tidemark.llm.decontaminate import without_hits
from tidemark.llm.jaccard_join import Rule, jaccard_groups, only
from tidemark.llm.mixing import poisson_mix
from tidemark.llm.queries import END_ID, MIX, MIX_WEIGHTS, tokenizer_path
from tidemark.llm.token_files import token_round_trip
from tidemark.llm.toxicity import score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees don't predict as toxic (score below 0.7)."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    rows = score_toxicity(docs.toDF(*names), model, [F.col(n) for n in names], names, text_col=names[docs.columns.index("text")])
    return rows.where("predicted = 0").select(*names).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (Jaccard 0.8 or more) the one with the smallest id.

    Rows are told apart by a 64-bit hash of id and text, so null and repeated ids lose no row that has no link; of rows with
    one id and one text that has words, one stays.  A null id comes after all others.
    """
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    groups = jaccard_groups(rows.select("__row", "text"), Rule(width=5, num=80, den=100), id_col="__row")
    groups = materialise(groups.where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("label")), "near-duplicates")
    linked = groups.where("label <> row")
    linked = linked.unionByName(linked.select(F.col("label").alias("row"), "label")).distinct()
    linked = materialise(rows.select("__row", "doc_id").join(linked, F.col("__row") == F.col("row")).select("row", "label", "doc_id"), "near-linked")
    stays = linked.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).select(F.col("least.row").alias("stays"))
    gone = materialise(linked.join(stays, F.col("row") == F.col("stays"), "left_anti").select(F.col("row").alias("__gone")).distinct(), "near-gone")
    again = materialise(groups.groupBy(F.col("row").alias("__again")).count().where("count > 1").drop("count"), "near-again")
    kept = only(rows, gone, {"__row": "__gone"}, keep=False, store=False)
    once = only(kept, again, {"__row": "__again"}, keep=False, store=False)
    return once.unionByName(only(kept, again, {"__row": "__again"}, store=False).dropDuplicates(["__row"])).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_hits(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights, in shuffled order."""
    return poisson_mix(docs, MIX_WEIGHTS, copy_col="__copy", order_col="__order", **MIX).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's token files, read back: doc_id, start, n_tokens, ids_crc32 of every row."""
    return token_round_trip(spark, docs, scratch_dir(spark, "token-files"), tokenizer_path(), end_id=END_ID)
