"""End-to-end plans composed of the operators: DataFrames in and out; some steps write tables while a plan is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import audits as au
from tidemark.operators import evaluation as el
from tidemark.operators import evidence as ev
from tidemark.operators import intervals as iv
from tidemark.operators import overlay as ov
from tidemark.operators import rollups as ru
from tidemark.operators import sampling as sm
from tidemark.operators import sequences as sq
from tidemark.operators.ordered import Order
from tidemark.session import materialise


def transcript_plan(
    primary: DataFrame, rivals: DataFrame, durations: DataFrame, order: Order, bucket_ms: int, **gap_rules,
) -> dict[str, DataFrame]:
    """Annotate, recover gaps, find disagreements, repair times, roll up quality.

    Stages that several later ones read are written to the shared folder, so they run once.
    """
    warned = materialise(sq.transcript_warnings(primary, order), "warned")
    decisions = materialise(iv.recover_gaps(warned, rivals, durations, bucket_ms, order=order, **gap_rules), "recovery")
    merged = iv.reconcile(warned, decisions, order)
    rows = merged.select(*order.keys, F.col("new_seq").alias("seq"), "start_ms", "end_ms", "text")
    by_seq = Order(order.keys, ("seq",))
    if order.chunk:
        rows = rows.withColumn("_chunk", F.floor(F.col("seq") / 1_000_000).cast("long"))
        by_seq = Order(order.keys, ("seq",), "_chunk")
    timed = sq.repair_durations(materialise(rows, "merged"), by_seq)
    cues = materialise(timed.withColumn("end_ms", F.col("new_end")).drop("new_end", "actions"), "cues")
    return {
        "warnings": warned, "disagreements": iv.disagreements(primary, rivals, bucket_ms, keys=order.keys), "recovery": decisions,
        "cues": cues, "quality": ru.qc_rollup(cues, by_seq, durations),
    }


def evidence_plan(
    units: DataFrame, witnesses: DataFrame, aliases, flips: ev.FlipRules, pairs: au.PairRules, required_rate: float,
) -> dict[str, DataFrame]:
    """Votes and fusion per unit, pair audit, review queue, evidence ceiling.

    ``units``: stream_id, seq, ``source, target_a, target_b, source_quality``.
    """
    witness = witnesses.withColumn("family", ev.canonical_family(F.col("family"), aliases))
    fused = ev.fuse_witnesses(witness, flips).withColumn(
        "block_alignment_status", F.when(F.col("alignment_strength") == "expanded", "single-block-expanded").otherwise("none")
    )
    audited = au.audit_pairs(units, pairs)
    keys = ["stream_id", "seq"]
    joined = audited.join(fused, keys, "left")
    conflict = joined.where("state = 'dual_conflict'").select(*keys, F.lit("high").alias("priority"), F.lit("witness-conflict").alias("code"))
    failed = audited.select(*keys, F.explode("hard_failures").alias("code")).select(*keys, F.lit("critical").alias("priority"), "code")
    doubt = units.where("source_quality <> 'trusted'").select(*keys, F.lit("medium").alias("priority"), F.lit("source-not-trusted").alias("code"))
    none = F.array().cast("array<string>")
    ceiling = ev.evidence_ceiling(
        joined.withColumns({"families": F.coalesce("families", none), "risk_codes": F.coalesce("risk_codes", none), "state": F.coalesce("state", F.lit("empty"))}), required_rate
    )
    return {"fusion": fused, "audit": audited, "queue": sm.review_queue([failed, conflict, doubt]), "ceiling": ceiling}


def decision_plan(
    segments: DataFrame, candidates: DataFrame, reference: DataFrame | None, keys: tuple[str, ...] = ("stream_id", "seq"),
) -> dict[str, DataFrame]:
    """Closed decisions per segment, their coverage and the claim they allow."""
    decided = ev.decide_candidates(candidates, segments, keys)
    return {"decisions": decided, "coverage": ov.key_coverage(segments, decided, keys), "claims": el.claim_check(decided, reference, keys)}


def risk_plan(rows: DataFrame, order: Order, reasons: list[DataFrame], risk: dict, first: int = 5) -> DataFrame:
    """Which streams are riskiest, and which rows a reviewer should look at first."""
    scored = ru.stream_risk(rows, order, **risk).select(*order.keys, "risk_score", "segments")
    head = sm.review_queue(reasons).where(F.col("rank") <= first)
    return scored.join(head, list(order.keys)).select(*order.keys, "risk_score", "segments", "rank", "seq", "priority", "reason_codes")
