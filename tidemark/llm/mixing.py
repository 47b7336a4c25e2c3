"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every source has a rate: the number of times its documents should appear on average so that the source reaches its share of
the mixture.  A document's count is Poisson with that mean, by inversion of a uniform number hashed from seed and id; it
depends on nothing else, so a rerun or a lost executor gives the same mixture.  A second hash deals the copies out to
partitions and orders each partition, which is a shuffle of the whole mixture.

Defined cases: a null source is a source of its own with the default weight; null or empty text has no characters, so
it repeats at its source's rate but adds nothing to the source's size; a source without any characters has rate 0; a null
id hashes as the empty text; rows that share an id share a count; an empty table stays empty; all other columns pass through
untouched, whatever their names (added names are given in ``copy_col`` and ``order_col``).
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def hashed_uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def first_count(rate: Column) -> Column:
    """The smallest count worth a place in the table: counts below have no weight that the uniform numbers could show."""
    return F.when(rate > 500, F.floor(rate - 12 * F.sqrt(rate))).otherwise(F.lit(0)).cast("int")


def poisson_table(rate: Column) -> Column:
    """P(count <= k) for k from ``first_count`` on, until what is left is below the resolution of the uniform numbers.

    The table has about 24 square roots of the rate as entries, however large the rate.
    """
    last, first = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"), first_count(rate)
    x = first.cast("double")
    # the logarithm of the first factorial, by Stirling's series
    start = F.when(first > 0, x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)).otherwise(F.lit(0.0))
    zero = F.struct(start.alias("log_fact"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))

    def step(acc, k):
        log_fact = acc["log_fact"] + F.when(k > first, F.log(k.cast("double"))).otherwise(F.lit(0.0))
        total = acc["sum"] + F.exp(k * F.log(rate) - rate - log_fact)
        return F.struct(log_fact.alias("log_fact"), total.alias("sum"), F.concat(acc["out"], F.array(total)).alias("out"))

    return F.when(rate > 0, F.aggregate(F.sequence(first, last), zero, step, lambda acc: acc["out"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float, epochs: float, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each source: its characters, its share of the mixture, its rate and the table of its counts."""
    size = F.sum(F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("long"))
    sized = docs.groupBy(F.col(source_col).alias("mix_source")).agg(size.alias("chars"))
    weight = F.coalesce(*(F.when(F.col("mix_source") == k, F.lit(float(v))) for k, v in sorted(weights.items())), F.lit(float(default_weight)))
    sized = sized.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0)))
    total = sized.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight")).first()  # one row
    chars, weight = float(total["all_chars"] or 0), float(total["all_weight"] or 0)
    rate = F.when((F.col("chars") > 0) & F.lit(weight > 0), F.lit(float(epochs)) * F.lit(chars) * F.col("weight") / F.lit(weight or 1.0) / F.col("chars")).otherwise(F.lit(0.0))
    return materialise(sized.withColumn("rate", rate).withColumns({"table": poisson_table(F.col("rate")), "first": first_count(F.col("rate"))}), "mix-rates")


def poisson_mix(
    docs: DataFrame, weights: Mapping[str, float], *, default_weight: float = 1.0, epochs: float = 1.0, seed: str = "mix-1",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy_no", order_col: str = "mix_order",
) -> DataFrame:
    """The mixture in shuffled order: the input's columns, the copy's number (from 1) and its random place in (0, 1).

    ``epochs`` times the input's characters are expected in all.  Rates are written down with their real size, so Spark
    broadcasts them only if they are small; beyond that a hot source is split by the adaptive join.
    """
    rates = source_rates(docs, weights, default_weight, epochs, source_col, text_col).select("mix_source", "table", "first")
    at, table, key, first = "__mix_u", "__mix_table", "__mix_source", "__mix_first"
    rates = rates.withColumnsRenamed({"mix_source": key, "table": table, "first": first})
    counted = docs.withColumn(at, hashed_uniform(seed, F.col(id_col))).join(rates, F.col(source_col).eqNullSafe(F.col(key)), "inner")
    count = (F.col(first) + F.size(F.filter(F.col(table), lambda c: c < F.col(at)))).cast("int")
    kept = counted.withColumn(table, count).where(F.col(table) > 0)
    copies = kept.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(table)))).drop(at, table, key, first)
    copies = copies.withColumn(order_col, hashed_uniform(f"{seed}/order", F.col(id_col), F.col(copy_col)))
    return copies.repartition(F.col(order_col)).sortWithinPartitions(order_col)
