"""Samples, blind assignments and review queues: seeded by hashes, so partitioning never changes them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import Order, chunked, fold_rows, position


def seeded(seed: str, *cols: str) -> Column:
    """Hex digest of the seed and columns: the order of every sample."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]), 256)


def hash_share(digest: Column) -> Column:
    """First 52 bits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def stratified_rounds(
    df: DataFrame, seed: str, size: int, quality: str = "quality", keys: Sequence[str] = ("stream_id",), at: str = "seq",
) -> DataFrame:
    """SMP2: one row per stratum in turn, hash order inside, until ``size`` rows per stream.

    Strata are the quality class and the third of the stream; only each stratum's first ``size``
    rows can be taken, so the ranking windows stop there.
    """
    keys = list(keys)
    totals = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = df.join(totals, keys)
    third = F.least(F.lit(2), F.floor((F.col(at) - 1) * 3 / F.greatest(F.lit(1), F.col("_n"))))
    rows = rows.withColumn("_band", third)
    rows = rows.withColumn("_h", seeded(seed, *keys, quality, "_band", at))
    inner = Window.partitionBy(*keys, quality, "_band").orderBy("_h", at)
    rows = rows.withColumn("_turn", F.row_number().over(inner)).where(F.col("_turn") <= size)
    outer = Window.partitionBy(*keys).orderBy("_turn", quality, "_band")
    return rows.withColumn("_r", F.row_number().over(outer)).where(F.col("_r") <= size).drop("_n", "_band", "_h", "_turn", "_r")


def quota_sample(
    df: DataFrame, categories: Sequence[str], seed: str, per_category: int = 6, total: int = 30, keys: Sequence[str] = ("stream_id",), at: str = "seq",
) -> DataFrame:
    """SMP3: up to ``per_category`` rows per category in fixed order, hash order inside, filled by baseline rows.

    ``category`` is null for rows that can only serve as baseline.
    """
    keys = list(keys)
    order = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(categories))):
        order = F.when(F.col("category") == name, i).otherwise(order)
    rows = df.withColumns({"_c": F.coalesce(order, F.lit(len(categories))), "_h": seeded(seed, *keys, at)})
    inner = Window.partitionBy(*keys, "_c").orderBy("_h", at)
    # the constant limit lets Spark drop most rows before the shuffle
    rows = rows.withColumn("_i", F.row_number().over(inner)).where(F.col("_i") <= max(per_category, total))
    quota = F.when(F.col("_c") < len(categories), per_category).otherwise(total)
    rows = rows.where(F.col("_i") <= quota)
    outer = Window.partitionBy(*keys).orderBy("_c", "_i")
    rows = rows.withColumn("pick", F.row_number().over(outer)).where(F.col("pick") <= total)
    why = F.when(F.col("_c") < len(categories), F.col("category")).otherwise("baseline")
    return rows.withColumn("picked_for", why).drop("_c", "_h", "_i")


def distinct_starts(picks: DataFrame, keys: Sequence[str] = ("stream_id",), step_ms: int = 500) -> DataFrame:
    """SMP3 (windows): picks in order take the nearest free start in +-step moves, unique per stream."""
    def settle(state, start, limit):
        used = set(state or [])
        k = 0
        place = start
        while True:
            options = [start] if k == 0 else [start + k * step_ms, start - k * step_ms]
            free = [o for o in options if 0 <= o <= limit and o not in used]
            if free:
                place = free[0]
                break
            if all(o < 0 or o > limit for o in options):
                break
            k += 1
        return [*(state or []), place], (place,)

    out = T.StructType([T.StructField("unique_start", T.LongType())])
    return fold_rows(picks, Order(tuple(keys), ("pick",)), ["start_ms", "limit_ms"], settle, out)


def bernoulli_audit(df: DataFrame, seed: str, rate: float, bands: Sequence[str], keys: Sequence[str] = ("stream_id",), at: str = "seq") -> DataFrame:
    """SMP4: each eligible row with probability ``rate`` by its own hash; at least one row per stream."""
    keys = list(keys)
    rows = df.where(F.col("band").isin(*bands)).withColumn("_h", seeded(seed, *keys, at))
    first = rows.groupBy(*keys).agg(F.min("_h").alias("_first"))
    rows = rows.join(first, keys)
    take = (hash_share(F.col("_h")) < rate) | (F.col("_h") == F.col("_first"))
    return rows.where(take).withColumns({"selection_probability": F.lit(rate), "review_result": F.lit("unreviewed")}).drop("_h", "_first")


def blind_pack(df: DataFrame, seed: str, left: str, right: str, keys: Sequence[str] = ("stream_id", "seq")) -> tuple[DataFrame, DataFrame]:
    """SMP5: public A/B rows and the sealed key, by the parity of a digest's first byte."""
    digest = F.sha2(F.concat_ws("\u0000", F.col(keys[0]).cast("string"), F.lit(seed), *[F.col(k).cast("string") for k in keys[1:]]), 256)
    even = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 2 == 0
    public = df.select(*keys, F.when(even, F.col(left)).otherwise(F.col(right)).alias("candidate_a"), F.when(even, F.col(right)).otherwise(F.col(left)).alias("candidate_b"))
    key = df.select(*keys, F.when(even, left).otherwise(right).alias("candidate_a_variant"), F.when(even, right).otherwise(left).alias("candidate_b_variant"))
    return public, key


def blind_three(df: DataFrame, seed: str, variants: Sequence[str], keys: Sequence[str] = ("stream_id", "seq")) -> DataFrame:
    """SMP5 (A/B/C): each row's variants ordered by their own digests."""
    base = F.concat_ws("\u0000", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    tagged = F.array_sort(F.array(*[F.struct(F.sha2(F.concat_ws("\u0000", base, F.lit(v)), 256).alias("h"), F.lit(v).alias("v")) for v in variants]))
    return df.select(*keys, *[F.get(tagged, i)["v"].alias(f"candidate_{chr(97 + i)}_variant") for i in range(len(variants))])


def commitment(key: DataFrame, cols: Sequence[str], scope: Sequence[str] = ("stream_id",)) -> DataFrame:
    """SMP5 (commitment): one digest per stream of its sealed key, whatever the row order.

    Row digests add up as numbers, so a hot stream is summed map-side and never listed.
    """
    row = F.sha2(F.concat_ws("\u0000", *[F.col(c).cast("string") for c in cols]), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"_p{i}") for i in range(8)]
    sums = key.groupBy(*scope).agg(F.count("*").alias("n_rows"), *parts)
    return sums.select(*scope, "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"_p{i}").cast("string") for i in range(8)]), 256).alias("commitment"))


# fixed values: states of a decision that hold a row back, and confidences that say little
HELD = ("abstained", "unresolved", "untranslated", "hold")
WEAK = ("", "low", "unknown")


def _told(rows: DataFrame, keys: Sequence[str], found: list[tuple[Column, Column | str, str, Column]]) -> DataFrame:
    """One row per (condition, priority, code, detail) that holds."""
    made = [F.when(c, F.struct((F.lit(p) if isinstance(p, str) else p).alias("priority"), F.lit(code).alias("code"), d.cast("string").alias("detail"))) for c, p, code, d in found]
    out = rows.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("r"))
    return out.select(*keys, "r.priority", "r.code", "r.detail").distinct()


def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def decision_reasons(decisions: DataFrame, keys: Sequence[str] = ("stream_id", "seq")) -> DataFrame:
    """TOP1 (decisions): held status, weak evidence, uncertain slots, open risks, missing refs.

    ``decisions``: keys, ``status, confidence, uncertain_slots, risk_codes, evidence_refs`` (arrays; null refs are no valid list).
    """
    status, confidence = F.lower(F.trim(F.coalesce("status", F.lit("")))), F.lower(F.trim(F.coalesce("confidence", F.lit(""))))
    slots, risks = _listed("uncertain_slots"), _listed("risk_codes")
    return _told(decisions, keys, [
        (status.isin(*HELD), "critical", "decision-status", status),
        (confidence.isin(*WEAK), "high", "low-evidence-strength", F.coalesce(F.nullif(confidence, F.lit("")), F.lit("missing"))),
        (F.size(slots) > 0, "high", "uncertain-slots", F.array_join(slots, ", ")),
        (F.size(risks) > 0, "high", "unresolved-risk-or-alternative", F.array_join(risks, ", ")),
        (F.size(_listed("evidence_refs")) == 0, "high", "missing-evidence-refs", F.lit(None)),
    ])


def ref_reasons(segments: DataFrame, decisions: DataFrame, contract: DataFrame, keys: Sequence[str] = ("stream_id", "seq")) -> DataFrame:
    """TOP1 (refs): segments whose contract allows no evidence, and decisions that cite what it does not allow.

    ``contract``: keys and ``evidence_refs``, the refs that a segment's decision may cite.
    """
    rows = segments.select(*keys).distinct().join(contract.select(*keys, F.col("evidence_refs").alias("_allowed")), list(keys), "left")
    rows = rows.join(decisions.select(*keys, F.col("evidence_refs").alias("_cited")), list(keys), "left")
    allowed, cited = _listed("_allowed"), _listed("_cited")
    stray = F.array_sort(F.array_except(cited, allowed))
    return _told(rows, keys, [
        (F.size(allowed) == 0, "high", "queue-evidence-contract", F.lit(None)),
        ((F.size(allowed) > 0) & (F.size(stray) > 0), "high", "unmapped-evidence-ref", F.array_join(stray, ", ")),
    ])


def consistency_reasons(applied: DataFrame, keys: Sequence[str] = ("stream_id", "seq"), weighty: Sequence[str] = ("register", "address_term")) -> DataFrame:
    """TOP1 (consistency): entries that JOIN12 withheld as conflicting or left unresolved.

    ``applied``: the result of ``apply_ledger``.  One reason per conflicting key, one per unresolved entry.
    """
    clash = applied.where("use = 'withheld_conflict'").groupBy(*keys, "entry_type", "scope", "key").agg(F.array_sort(F.collect_set(F.col("entry_id").cast("string"))).alias("ids"))
    open_ = applied.where("use = 'unresolved'")
    first = _told(clash, keys, [(F.lit(True), "high", "consistency-conflict", F.concat(F.col("entry_type"), F.lit(":"), F.array_join("ids", ",")))])
    urgent = F.when(F.col("entry_type").isin(*weighty), "high").otherwise("medium")
    second = _told(open_, keys, [(F.lit(True), urgent, "consistency-unresolved", F.concat(F.col("entry_type"), F.lit(":"), F.col("entry_id").cast("string")))])
    return first.unionByName(second)


def band_reasons(prior: DataFrame, keys: Sequence[str] = ("stream_id", "seq")) -> DataFrame:
    """TOP1 (bands): what an earlier risk queue said.  ``prior``: keys, ``band, confidence, uncertain_scope``."""
    confidence, scope = F.lower(F.trim(F.coalesce("confidence", F.lit("")))), F.trim(F.coalesce("uncertain_scope", F.lit("")))
    return _told(prior, keys, [
        (F.col("band") == "P1", "high", "prior-p1", F.col("band")), (F.col("band") == "P2", "medium", "prior-p2", F.col("band")),
        (confidence == "low", "high", "prior-low-confidence", confidence), (confidence == "medium", "medium", "prior-medium-confidence", confidence),
        (scope != "", "high", "prior-uncertain-scope", scope),
    ])


def issue_reasons(issues: DataFrame, keys: Sequence[str] = ("stream_id", "seq")) -> DataFrame:
    """TOP1 (issues): findings of a rule audit, by the ``variant`` of the text that was audited."""
    rows = issues.where(F.col(keys[-1]).isNotNull()).withColumn("_code", F.concat_ws(":", "variant", "code"))
    urgent = F.when(F.col("severity") == "error", "critical").otherwise("medium")
    return rows.select(*keys, urgent.alias("priority"), F.col("_code").alias("code"), F.col("severity").alias("detail")).distinct()


# fixed values: priority names from most to least urgent
PRIORITY = ("critical", "high", "medium")


def review_queue(
    reasons: Sequence[DataFrame] | DataFrame, keys: Sequence[str] = ("stream_id", "seq"), width: int = 100_000,
) -> DataFrame:
    """TOP1: rows with at least one reason, ranked per stream by best priority and position.

    Every input: keys, ``priority, code``.  Ranks are counted per (priority, position block).
    """
    rows = reasons if isinstance(reasons, DataFrame) else reduce(DataFrame.unionByName, reasons)
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("priority")).cast("int")
    per = rows.withColumn("_p", rank).groupBy(*keys).agg(
        F.min("_p").alias("_p"), F.array_sort(F.collect_set(F.struct(F.col("_p").alias("p"), "code"))).alias("_codes")
    )
    per = per.withColumns({"priority": F.get(F.array(*map(F.lit, PRIORITY)), F.col("_p") - 1), "reason_codes": F.col("_codes.code")})
    # a chunk that grows with (priority, position), so no stream is ranked in one task
    wide = F.col("_p").cast("long") * 1_000_000_000_000 + F.floor(F.col(keys[-1]) / width)
    per = per.withColumn("_chunk", wide)
    order = Order(tuple(keys[:-1]), ("_p", keys[-1]), "_chunk")
    return position(per, order, "rank").select(*keys, "rank", "priority", "reason_codes")


def ambiguous_first(df: DataFrame, limit: int, keys: Sequence[str] = ("stream_id",), at: str = "seq") -> DataFrame:
    """TOP2: the first ``limit`` ambiguous rows per stream: low confidence, not trusted, position."""
    low, doubt = F.col("confidence") == "low", F.col("quality") != "trusted"
    why = F.array_compact(F.array(F.when(low, "low_confidence"), F.when(doubt, "source_not_trusted")))
    rows = df.withColumn("selection_reasons", why).where(F.size("selection_reasons") > 0)
    w = Window.partitionBy(*keys).orderBy(low.desc(), doubt.desc(), F.col(at))
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= limit)
