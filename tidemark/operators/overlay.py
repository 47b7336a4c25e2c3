"""Overlays, coverage, integrity, contracts and lineage over keyed tables.

A merge is accepted or rejected per stream: the guard is an aggregate per stream joined back,
so one bad stream never stops the others and nothing is checked on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import Order, neighbour, position

KEYS = ("stream_id", "seq")


def times(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def structure_diff(left: DataFrame, right: DataFrame, order: Order) -> DataFrame:
    """JOIN14: rows that differ by position in number or time, exist on one side, or run backwards."""
    keys = list(order.keys)

    def placed(df: DataFrame, side: str) -> DataFrame:
        rows = position(df, order, "pos")
        return rows.select(*keys, "pos", F.struct("seq", "start_ms", "end_ms").alias(side))

    both = placed(left, "l").join(placed(right, "r"), [*keys, "pos"], "full_outer")
    codes = F.array_compact(
        F.array(
            F.when(F.col("r").isNull(), "missing_right"), F.when(F.col("l").isNull(), "missing_left"),
            F.when(F.col("l.seq") != F.col("r.seq"), "number_changed"),
            F.when((F.col("l.start_ms") != F.col("r.start_ms")) | (F.col("l.end_ms") != F.col("r.end_ms")), "time_changed"),
        )
    )
    return both.select(*keys, "pos", F.explode(codes).alias("code"))


def same_structure(left: DataFrame, right: DataFrame, order: Order) -> DataFrame:
    """JOIN14 (verdict): per stream whether both tables have the same rows, numbers and times."""
    keys = list(order.keys)
    bad = structure_diff(left, right, order).groupBy(*keys).agg(F.count("*").alias("differences"))
    streams = left.select(*keys).union(right.select(*keys)).distinct()
    out = streams.join(bad, keys, "left").withColumn("differences", F.coalesce("differences", F.lit(0)))
    return out.withColumn("same", F.col("differences") == 0)


def key_coverage(expected: DataFrame, supplied: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """JOIN15: missing, extra and duplicate keys."""
    counts = supplied.groupBy(*keys).agg(F.count("*").alias("_n"))
    want = expected.select(*keys).distinct().withColumn("_w", F.lit(1))
    both = want.join(counts, list(keys), "full_outer")
    codes = F.array_compact(
        F.array(F.when(F.col("_n").isNull(), "missing"), F.when(F.col("_w").isNull(), "extra"), F.when(F.col("_n") > 1, "duplicate"))
    )
    return both.select(*keys, F.explode(codes).alias("issue"))


def orphan_refs(rows: DataFrame, allowed: DataFrame, refs: str = "refs", keys: Sequence[str] = KEYS, scope: Sequence[str] = ("stream_id",)) -> DataFrame:
    """JOIN16: references not in the allowed set of the same scope."""
    used = rows.select(*keys, F.explode(F.array_distinct(refs)).alias("ref"))
    return used.join(allowed.select(*scope, "ref").distinct(), [*scope, "ref"], "left_anti").select(*keys, "ref")


def unacknowledged(rows: DataFrame, conflicts: str, acknowledged: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """JOIN16 (conflicts): conflict ids of a row it does not acknowledge."""
    left = F.array_sort(F.array_except(conflicts, acknowledged))
    return rows.select(*keys, left.alias("open_conflicts")).where(F.size("open_conflicts") > 0)


def _guard(base: DataFrame, patch: DataFrame, scope: Sequence[str], keys: Sequence[str], extra: Sequence[DataFrame] = ()) -> DataFrame:
    """Streams whose patch has unknown or repeated keys (or further problems)."""
    known = base.select(*keys, F.lit(1).alias("_b"))
    counts = patch.groupBy(*keys).agg(F.count("*").alias("_n"))
    bad = counts.join(known, list(keys), "left").where("_b is null or _n > 1").select(*scope)
    return _union([bad, *[e.select(*scope) for e in extra]]).distinct().withColumn("_rejected", F.lit(True))


def overlay_fields(base: DataFrame, reviewed: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEYS, scope: Sequence[str] = ("stream_id",)) -> DataFrame:
    """JOIN17 (a): reviewed, non-null fields over the base rows."""
    bad = _guard(base, reviewed, scope, keys)
    r = reviewed.dropDuplicates(list(keys)).select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields], F.lit(True).alias("_hit"))
    out = base.join(r, list(keys), "left").join(bad, list(scope), "left")
    use = F.col("_rejected").isNull()
    out = out.withColumns({f: F.when(use, F.coalesce(f"_r_{f}", f)).otherwise(F.col(f)) for f in fields})
    status = F.when(~use, "rejected").when(F.col("_hit"), "merged").otherwise("unchanged")
    return out.withColumn("merge_status", status).drop("_hit", "_rejected", *[f"_r_{f}" for f in fields])


def replace_or_hold(
    base: DataFrame, decisions: DataFrame, reviews: DataFrame, hold: str = "…", keys: Sequence[str] = KEYS,
    scope: Sequence[str] = ("stream_id",), must_answer: Column | None = None,
) -> DataFrame:
    """JOIN17 (b): no decision leaves a row; a replacement stands only if its review keeps it; else hold.

    With ``must_answer`` every base row it selects needs a decision, or the stream is rejected.
    """
    gaps = []
    if must_answer is not None:
        gaps.append(base.where(must_answer).join(decisions.select(*keys), list(keys), "left_anti"))
    repeats = reviews.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    bad = _guard(base, decisions, scope, keys, [*gaps, repeats])
    d = decisions.dropDuplicates(list(keys)).select(*keys, F.col("action").alias("_action"), F.col("text").alias("_new"))
    v = reviews.dropDuplicates(list(keys)).select(*keys, F.col("verdict").alias("_verdict"))
    out = base.join(d, list(keys), "left").join(v, list(keys), "left").join(bad, list(scope), "left")
    kept = (F.col("_action") == "replace") & (F.coalesce("_verdict", F.lit("keep")) == "keep")
    method = F.when(F.col("_rejected"), "rejected").when(F.col("_action").isNull(), "unchanged").when(kept, "replaced").otherwise("held")
    return out.withColumns(
        {"method": method, "text": F.when(method == "replaced", F.trim("_new")).when(method == "held", F.lit(hold)).otherwise(F.col("text"))}
    ).drop("_action", "_new", "_verdict", "_rejected")


def guarded_patch(base: DataFrame, patches: DataFrame, order: Order, scope: Sequence[str] = ("stream_id",)) -> DataFrame:
    """JOIN17 (c): drop or replace rows that still read as expected, then renumber.

    ``patches``: keys, ``expected_before, action, after, new_end``.  A drifted row, an unknown
    action, an empty replacement or an end before its start rejects the stream.
    """
    keys = [*order.keys, "seq"]
    joined = base.join(patches, keys)
    wrong = joined.where(
        ~F.col("text").eqNullSafe(F.col("expected_before")) | ~F.col("action").isin("drop", "replace")
        | ((F.col("action") == "replace") & (F.trim(F.coalesce("after", F.lit(""))) == ""))
        | (F.coalesce("new_end", "end_ms") <= F.col("start_ms"))
    )
    bad = _guard(base, patches, scope, keys, [wrong])
    p = patches.dropDuplicates(keys).select(*keys, "action", "after", "new_end")
    out = base.join(p, keys, "left").join(bad, list(scope), "left")
    live = F.col("_rejected").isNull() & F.col("action").isNotNull()
    out = out.where(~live | (F.col("action") != "drop"))
    out = out.withColumns(
        {
            "text": F.when(live, F.col("after")).otherwise(F.col("text")), "end_ms": F.when(live, F.coalesce("new_end", "end_ms")).otherwise(F.col("end_ms")),
            "patch_status": F.when(F.col("_rejected"), "rejected").when(live, "patched").otherwise("unchanged"),
        }
    ).drop("action", "after", "new_end", "_rejected")
    return position(out, order, "new_seq")


def strict_replace(base: DataFrame, replacement: DataFrame, keys: Sequence[str] = KEYS, scope: Sequence[str] = ("stream_id",)) -> DataFrame:
    """JOIN17 (d): all rows of a stream are replaced, or none if any row is missing, extra, repeated or blank."""
    gaps = key_coverage(base, replacement, keys)
    blank = replacement.where(F.trim(F.coalesce("text", F.lit(""))) == "")
    bad = _union([gaps.select(*scope), blank.select(*scope)]).distinct().withColumn("_rejected", F.lit(True))
    r = replacement.dropDuplicates(list(keys)).select(*keys, F.col("text").alias("_new"))
    out = base.join(r, list(keys), "left").join(bad, list(scope), "left")
    return out.withColumns(
        {"text": F.when(F.col("_rejected"), F.col("text")).otherwise(F.col("_new")), "replaced": F.col("_rejected").isNull()}
    ).drop("_new", "_rejected")


def priority_coalesce(
    structure: DataFrame, candidates: Sequence[tuple[str, DataFrame]], order: Order, reject: str | None = None, hold: str = "",
) -> DataFrame:
    """JOIN18: the first usable text by candidate priority, its origin, ``abstained`` if there is none.

    A candidate table whose structure differs in a stream is left out for that stream.
    """
    keys = [*order.keys, "seq"]
    slim = structure.select(*order.part, *[c for c in dict.fromkeys([*order.by, "seq", "start_ms", "end_ms"]) if c not in order.part])
    offers = []
    for rank, (name, table) in enumerate(candidates):
        bad = structure_diff(slim, table, order).select(*order.keys).distinct()
        ok = F.trim(F.coalesce("text", F.lit(""))) != ""
        if reject is not None:
            ok = ok & ~F.col("text").rlike(reject)
        good = table.where(ok).join(bad, list(order.keys), "left_anti")
        offers.append(good.select(*keys, F.lit(rank).alias("_rank"), F.lit(name).alias("origin"), "text"))
    best = _union(offers).groupBy(*keys).agg(F.min_by(F.struct("origin", "text"), "_rank").alias("_b"))
    out = structure.drop("text").join(best, keys, "left")
    return out.withColumns(
        {"text": F.coalesce("_b.text", F.lit(hold)), "origin": F.coalesce("_b.origin", F.lit("abstained"))}
    ).drop("_b")


def artifact_agreement(rendered: DataFrame, audit: DataFrame, order: Order) -> DataFrame:
    """JOIN19: positional differences of id, text and time between two written tables, and repeated ids."""
    keys = list(order.keys)

    def placed(df: DataFrame, side: str) -> DataFrame:
        return position(df, order, "pos").select(*keys, "pos", F.struct("seq", "text", "start_ms", "end_ms").alias(side))

    both = placed(rendered, "l").join(placed(audit, "r"), [*keys, "pos"], "full_outer")
    codes = F.array_compact(
        F.array(
            F.when(F.col("l").isNull() | F.col("r").isNull(), "count_mismatch"), F.when(F.col("l.seq") != F.col("r.seq"), "id_mismatch"),
            F.when(F.col("l.text") != F.col("r.text"), "text_mismatch"),
            F.when((F.col("l.start_ms") != F.col("r.start_ms")) | (F.col("l.end_ms") != F.col("r.end_ms")), "time_mismatch"),
        )
    )
    diffs = both.select(*keys, "pos", F.explode(codes).alias("code"))
    again = rendered.groupBy(*keys, "seq").agg(F.count("*").alias("n")).where("n > 1")
    return diffs.unionByName(again.select(*keys, F.col("seq").alias("pos"), F.lit("repeated_id").alias("code")))


# --- reports -------------------------------------------------------------------------------


def change_report(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS, defect: Column | None = None) -> DataFrame:
    """AGG30: row status between two versions, whether untouched rows are byte-identical, new defects."""
    b = before.select(*keys, F.col("text").alias("_b"), F.sha2("text", 256).alias("_bh"), *([defect.alias("_bd")] if defect is not None else []))
    a = after.select(*keys, F.col("text").alias("_a"), F.sha2("text", 256).alias("_ah"), *([defect.alias("_ad")] if defect is not None else []))
    out = b.join(a, list(keys), "full_outer")
    status = F.when(F.col("_ah").isNull(), "removed").when(F.col("_bh").isNull(), "added").when(F.col("_ah") == F.col("_bh"), "unchanged").otherwise("changed")
    new = F.coalesce(F.col("_ad"), F.lit(False)) & ~F.coalesce(F.col("_bd"), F.lit(False)) if defect is not None else F.lit(False)
    return out.select(*keys, status.alias("change"), new.alias("new_defect"), F.col("_ah").alias("sha256"))


def defect_delta(before: DataFrame, after: DataFrame, order: Order) -> DataFrame:
    """AGG30 (QA): invalid rows new in ``after`` and out-of-order rows beyond those already there."""
    keys = list(order.keys)

    def defects(df: DataFrame, tag: str) -> DataFrame:
        rows = neighbour(df, order, {"_ps": F.col("start_ms")})
        return rows.groupBy(*keys).agg(
            times(F.col("end_ms") <= F.col("start_ms")).alias(f"{tag}_invalid"), times(F.col("start_ms") < F.col("_ps")).alias(f"{tag}_backward")
        )

    invalid = lambda df: df.where("end_ms <= start_ms").select(*keys, "seq")
    fresh = invalid(after).join(invalid(before), [*keys, "seq"], "left_anti").groupBy(*keys).agg(F.count("*").alias("new_invalid"))
    out = defects(before, "before").join(defects(after, "after"), keys, "full_outer").join(fresh, keys, "left")
    out = out.withColumn("new_invalid", F.coalesce("new_invalid", F.lit(0)))
    return out.withColumn("new_backward", F.greatest(F.lit(0), F.col("after_backward") - F.col("before_backward")))


def uncertainty_report(decisions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG30 (uncertainty): rows uncertain by status, confidence or open slots."""
    why = F.array_compact(
        F.array(
            F.when(F.col("status").isin("abstained", "unresolved", "hold"), "status"), F.when(F.coalesce("confidence", F.lit("")).isin("", "low", "unknown"), "confidence"),
            F.when(F.size("uncertain_slots") > 0, "slots"),
        )
    )
    return decisions.select(*keys, why.alias("why")).where(F.size("why") > 0)


def lineage_graph(
    segments: DataFrame, evidence: DataFrame, decisions: DataFrame, evaluations: DataFrame,
    frames: DataFrame | None = None, hypotheses: DataFrame | None = None, parts: int | None = None, distinct: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """AGG31: nodes and edges of streams, timelines, segments, evidence, decisions, frames, hypotheses and evaluations.

    ``evidence``: stream_id, seq, ``ref``.  ``decisions``: stream_id, seq, ``refs`` (array).  ``evaluations``: stream_id,
    ``evaluation_id``.  ``frames``: stream_id, seq.  ``hypotheses``: stream_id, seq, ``hypothesis_id``, ``refs``.  A stream contains its
    segments, its timeline is aligned to them; evidence supports segments, and the decisions and hypotheses that cite it; decisions, frames and
    hypotheses are derived from their segment; an evaluation is of a stream.  Ends that are no node get no edge but from a decision or
    frame to its segment: ``unknown_refs`` lists what cites unknown evidence.  ``parts`` partitions (the session's number, if not given) hold
    nodes, edges and citations; a number that grows with the rows keeps a task's memory the same.  With ``distinct=False`` nodes and edges may repeat.
    """
    streams = segments.select("stream_id").distinct()
    stream, line, seg = _node_id("stream", "stream_id"), _node_id("timeline", "stream_id"), _node_id("segment", "stream_id", "seq")
    ev, dec, frame = _node_id("evidence", "stream_id", "ref"), _node_id("decision", "stream_id", "seq"), _node_id("frame", "stream_id", "seq")
    evl, hyp = _node_id("evaluation", "stream_id", "evaluation_id"), _node_id("hypothesis", "stream_id", "seq", "hypothesis_id")
    known = _spread(evidence.select("stream_id", "ref"), parts, "stream_id", "ref").distinct()
    there = segments.select("stream_id", "seq").distinct()
    evaluated = evaluations.select("stream_id", "evaluation_id").distinct()

    def node(df: DataFrame, ident: Column, kind: str) -> DataFrame:
        return df.select(ident.alias("id"), F.lit(kind).alias("kind"))

    def edge(df: DataFrame, source: Column, relation: str, target: Column) -> DataFrame:
        return df.select(source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"))

    nodes = [
        node(streams, stream, "stream"), node(streams, line, "timeline"), node(segments, seg, "segment"), node(known, ev, "evidence"),
        node(decisions, dec, "decision"), node(evaluated, evl, "evaluation"),
    ]
    edges = [
        edge(segments, stream, "contains", seg), edge(segments, line, "aligned_to", seg), edge(evidence, ev, "supports", seg),
        edge(decisions, dec, "derived_from", seg), edge(_spread(_cited(decisions), parts, "stream_id", "ref").join(known, ["stream_id", "ref"]), ev, "supports", dec), edge(evaluated, evl, "evaluated_by", stream),
    ]
    if frames is not None:
        nodes.append(node(frames, frame, "frame"))
        edges.append(edge(frames, frame, "derived_from", seg))
    if hypotheses is not None:
        nodes.append(node(hypotheses, hyp, "hypothesis"))
        placed = _spread(hypotheses, parts, "stream_id", "seq").join(_spread(there, parts, "stream_id", "seq"), ["stream_id", "seq"])
        edges.append(edge(placed, hyp, "derived_from", seg))
        edges.append(edge(_spread(_cited(hypotheses, "hypothesis_id"), parts, "stream_id", "ref").join(known, ["stream_id", "ref"]), ev, "supports", hyp))
    if not distinct:
        return _union(nodes), _union(edges)
    return _spread(_union(nodes), parts, "id").dropDuplicates(["id"]), _spread(_union(edges), parts, "source", "target").dropDuplicates()


def _spread(df: DataFrame, parts: int | None, *cols: str) -> DataFrame:
    return df.repartition(parts, *cols) if parts else df


def _node_id(kind: str, *cols: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in cols])


def _cited(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("stream_id", "seq", *more, F.explode("refs").alias("ref"))


def unknown_refs(evidence: DataFrame, decisions: DataFrame, hypotheses: DataFrame | None = None) -> DataFrame:
    """AGG31 (report): refs of decisions and hypotheses that name no evidence, and where they stand."""
    known = evidence.select("stream_id", "ref").distinct()
    cited = _cited(decisions).withColumn("location", F.lit("decision"))
    if hypotheses is not None:
        cited = cited.unionByName(_cited(hypotheses).withColumn("location", F.lit("hypothesis.supported_by")))
    return cited.join(known, ["stream_id", "ref"], "left_anti").select("stream_id", "seq", "ref", "location").distinct()


def graph_orphans(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """AGG31 (check): edge ends that are not nodes; both tables may repeat rows."""
    ends = _spread(edges.select(F.explode(F.array("source", "target")).alias("id"), "relation"), parts, "id")
    return ends.join(_spread(nodes.select("id"), parts, "id"), "id", "left_anti").distinct()


@dataclass(frozen=True)
class Contract:
    """AGG33: declared rules of a record table; conditions are (code, condition that must hold)."""

    required: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    conditions: tuple[tuple[str, Column], ...] = ()
    unique: tuple[str, ...] = ()


def contract_violations(df: DataFrame, contract: Contract, keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG33: one row per broken rule."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    checks = [F.when(blank(c), F.lit(f"required:{c}")) for c in contract.required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), F.lit(f"enum:{c}")) for c, allowed in contract.enums.items()]
    checks += [F.when(~F.coalesce(cond, F.lit(False)), F.lit(f"rule:{code}")) for code, cond in contract.conditions]
    rows = df.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("violation"))
    if contract.unique:
        again = df.groupBy(*contract.unique).agg(F.count("*").alias("_n")).where("_n > 1").select(*contract.unique)
        dup = df.join(again, list(contract.unique), "left_semi").select(*keys, F.lit("duplicate_id").alias("violation"))
        rows = rows.unionByName(dup)
    return rows


# fixed values: review states and the moves a deferred unit may make
TERMINAL = ("approved", "rejected")
FROM_DEFERRED = ("deferred", "approved", "rejected")


def fold_log(log: DataFrame, order: Order, unit: Sequence[str] = ("stream_id", "unit_id")) -> DataFrame:
    """AGG37: latest state per unit and whether its history chains; any break rejects the stream's log.

    ``log``: unit keys, ``line, status, previous_status``; ``order`` is over the unit by line.
    """
    clean = lambda c: F.when(F.col(c).isin("held", "hold"), "deferred").otherwise(F.col(c))
    rows = log.withColumns({"status": clean("status"), "previous_status": clean("previous_status")})
    rows = neighbour(rows, order, {"_before": F.col("status")})
    before = F.coalesce("_before", F.lit("pending"))
    wrong = (
        (F.col("previous_status") != before)
        | (before.isin(*TERMINAL) & (F.col("status") != before))
        | ((before == "deferred") & ~F.col("status").isin(*FROM_DEFERRED))
        | (F.col("_before").eqNullSafe(F.lit("pending")) & (F.col("status") == "pending"))
    )
    units = rows.groupBy(*unit).agg(F.max_by("status", F.struct(*order.by)).alias("status"), times(wrong).alias("breaks"), F.count("*").alias("entries"))
    scope = list(unit[:1])
    broken = units.where("breaks > 0").select(*scope).distinct().withColumn("_r", F.lit(True))
    return units.join(broken, scope, "left").withColumn("log_rejected", F.coalesce("_r", F.lit(False))).drop("_r")


def package_units(units: DataFrame, texts: DataFrame, keys: Sequence[str] = KEYS, scope: Sequence[str] = ("stream_id",), hold: str = "[held]") -> DataFrame:
    """AGG38: candidate or held per unit; a stream whose texts do not cover every unit once is incomplete.

    ``units``: keys, ``refs, quality, review_status, gates_passed``.  ``texts``: keys, ``faithful, natural``.
    """
    bad = key_coverage(units, texts, keys).select(*scope).distinct().withColumn("_bad", F.lit(True))
    out = units.join(texts.dropDuplicates(list(keys)), list(keys), "left").join(bad, list(scope), "left")
    ready = (
        (F.size("refs") > 0) & (F.trim(F.coalesce("faithful", F.lit(""))) != "") & (F.trim(F.coalesce("natural", F.lit(""))) != "")
        & ((F.col("quality") == "trusted") | (F.col("review_status") == "approved")) & ~(F.col("review_status") == "rejected") & F.col("gates_passed")
    )
    state = F.when(F.col("_bad"), "incomplete").when(F.coalesce(ready, F.lit(False)), "candidate").otherwise("held")
    return out.withColumns(
        {"package_state": state, "package_text": F.when(state == "candidate", F.col("natural")).otherwise(F.lit(hold))}
    ).drop("_bad")


def package_counts(packaged: DataFrame, scope: Sequence[str] = ("stream_id",)) -> DataFrame:
    return packaged.groupBy(*scope).agg(*[times(F.col("package_state") == s).alias(s) for s in ("candidate", "held", "incomplete")])


def unreviewed_risk(decisions: DataFrame, reviews: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG39: risky rows that no review covers, with the risks they carry."""
    why = F.array_compact(
        F.array(
            F.when(F.col("confidence") == "low", "low_confidence"), F.when(F.col("status") == "abstained", "abstained"), F.when(F.size("risk_codes") > 0, "risk"),
            F.when(F.col("inferred"), "inferred"), F.when(F.col("competing"), "competing"),
        )
    )
    return decisions.select(*keys, why.alias("why")).where(F.size("why") > 0).join(reviews.select(*keys), list(keys), "left_anti")


def reconcile_totals(decisions: DataFrame, report: DataFrame, scope: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG39 (totals): streams whose report disagrees with its rows."""
    real = decisions.groupBy(*scope).agg(F.count("*").alias("rows"), times(F.col("status") == "accepted").alias("accepted"), times(F.col("status") == "abstained").alias("abstained"))
    out = real.join(report.select(*scope, *[F.col(c).alias(f"report_{c}") for c in ("rows", "accepted", "abstained")]), list(scope), "full_outer")
    same = F.lit(True)
    for c in ("rows", "accepted", "abstained"):
        same = same & F.col(c).eqNullSafe(F.col(f"report_{c}"))
    return out.withColumn("reconciled", same)


def two_context_proposals(targets: DataFrame, readings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG40: a target's text is replaced only if its core and context readings agree and are not empty."""
    from tidemark.functions.text import compact

    both = readings.groupBy(*keys).agg(
        *[F.max(F.when(F.col("window") == w, F.col("text"))).alias(f"_{w}") for w in ("core", "context")]
    )
    out = targets.join(both, list(keys), "left")
    core, ctx = compact(F.coalesce("_core", F.lit(""))), compact(F.coalesce("_context", F.lit("")))
    agree = (core != "") & (core == ctx)
    return out.withColumns(
        {"proposal": F.when(agree, "replace").otherwise("review"), "text": F.when(agree, F.col("_core")).otherwise(F.col("text"))}
    ).drop("_core", "_context")


def confirmed_profiles(profiles: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("stream_id", "speaker_id")) -> DataFrame:
    """AGG41: confirmed profiles of wanted speakers; two confirmed rows for one speaker are an error."""
    ok = profiles.where("status = 'confirmed'").join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    out = ok.groupBy(*keys).agg(F.count("*").alias("confirmed_rows"), F.min("profile_id").alias("profile_id"))
    return out.withColumns(
        {"status": F.when(F.col("confirmed_rows") == 1, "ok").otherwise("ambiguous"), "profile_id": F.when(F.col("confirmed_rows") == 1, F.col("profile_id"))}
    )


def effect_report(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS, scope: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG42: changed rows, low-confidence rows before and after, critical rows."""
    b = before.select(*keys, F.col("text").alias("_bt"), F.col("confidence").alias("_bc"))
    both = b.join(after, list(keys))
    return both.groupBy(*scope).agg(
        F.count("*").alias("compared"), times(~F.col("text").eqNullSafe(F.col("_bt"))).alias("changed"),
        times(F.col("_bc") == "low").alias("low_before"), times(F.col("confidence") == "low").alias("low_after"), times(F.col("severity") == "critical").alias("critical"),
    )
