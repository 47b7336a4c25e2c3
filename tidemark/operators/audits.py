"""Rule audits over many rows: one projection makes the findings, aggregates make the verdicts.

Rules are plain values given by the caller and become literal patterns in one projection,
so a pattern is compiled once per task and no rule table has to be joined to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded
from tidemark.operators.ordered import Order, neighbour

# fixed values: control characters, spacing and punctuation patterns, default limits
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACING = r" {2,}|\t"
PUNCTUATION = r"[!?！？。]{2,}|\.{3,}"
MAX_LINES, MAX_LINE_CHARS, MAX_CPS = 2, 42, 16.0


def finding(code: str, severity: str, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")
    )


@dataclass(frozen=True)
class SegmentRules:
    forbidden: str | None = None
    placeholders: tuple[str, ...] = ()
    work_tags: tuple[str, ...] = ()
    broken: str = "�"
    max_lines: int = MAX_LINES
    max_line_chars: int = MAX_LINE_CHARS
    max_cps: float = MAX_CPS
    reuse: int = 3


def segment_issues(df: DataFrame, order: Order, rules: SegmentRules = SegmentRules()) -> DataFrame:
    """AUD1: long issue table; wordings used too often in a stream give one row without ``seq``."""
    # used by several checks: computed once, as columns
    df = df.withColumns({"_key": tx.squeeze(F.col("text")), "_solid": F.length(tx.compact(F.col("text")))})
    text, key, solid = F.col("text"), F.col("_key"), F.col("_solid")
    df = neighbour(df, order, {"_pkey": key})
    span = F.col("end_ms") - F.col("start_ms")
    speed = F.when(span > 0, solid * F.lit(1000.0) / span)
    checks = [F.when(key == "", finding("empty_text", "error"))]
    if rules.forbidden:
        checks.append(F.when(text.rlike(rules.forbidden), finding("forbidden_script", "error")))
    checks += [F.when(text.contains(p), finding("placeholder", "error", F.lit(p))) for p in rules.placeholders]
    checks += [F.when(text.contains(p), finding("work_tag", "error", F.lit(p))) for p in rules.work_tags]
    checks += [
        F.when(text.rlike(rules.broken), finding("broken_character", "error")),
        F.when(text.rlike(CONTROL), finding("control_character", "error")),
        F.when(text.rlike(SPACING), finding("abnormal_space", "warning")),
        F.when(text.rlike(PUNCTUATION), finding("repeated_punctuation", "warning")),
        F.when(F.size(tx.lines(text)) > rules.max_lines, finding("too_many_lines", "error")),
        F.when(speed.isNull(), finding("high_cps", "warning", F.lit("inf"))),
        F.when(speed > rules.max_cps, finding("high_cps", "warning", rounded(speed, 2))),
        F.when((span >= 1000) & (solid < 2), finding("fragment_candidate", "warning")),
        F.when((key != "") & (key == F.col("_pkey")), finding("consecutive_duplicate", "warning")),
        F.when(F.rtrim(text).endswith(".") & text.contains("?"), finding("question_regression_candidate", "warning")),
    ]
    long_lines = F.transform(
        F.filter(tx.lines(text), lambda x: F.length(x) > rules.max_line_chars),
        lambda x: finding("long_line", "warning", F.length(x)),
    )
    found = F.concat(F.array_compact(F.array(*checks)), long_lines)
    rows = df.select(*order.keys, "seq", F.explode(found).alias("i")).select(*order.keys, "seq", "i.code", "i.severity", "i.detail")
    reused = df.where(key != "").groupBy(*order.keys, "_key").agg(F.count("*").alias("n")).where(F.col("n") >= rules.reuse)
    again = reused.select(
        *order.keys, F.lit(None).cast("long").alias("seq"), F.lit("reused_candidate").alias("code"),
        F.lit("warning").alias("severity"), F.concat_ws("x", F.col("n").cast("string"), "_key").alias("detail"),
    )
    return rows.unionByName(again)


def stream_status(issues: DataFrame, streams: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AUD1 (verdict): fail beats warning beats pass; streams without issues pass."""
    worst = issues.groupBy(*keys).agg(
        F.max((F.col("severity") == "error").cast("int")).alias("_e"), F.count("*").alias("issues")
    )
    out = streams.select(*keys).distinct().join(worst, list(keys), "left")
    status = F.when(F.col("_e") == 1, "fail").when(F.col("_e") == 0, "warning").otherwise("pass")
    return out.select(*keys, F.coalesce("issues", F.lit(0)).alias("issues"), status.alias("status"))


@dataclass(frozen=True)
class PairRule:
    """If ``source`` matches, ``target`` must match; ``added`` warns when only the target matches."""

    code: str
    source: str
    target: str
    added: str | None = None


@dataclass(frozen=True)
class PairRules:
    rules: tuple[PairRule, ...] = ()
    number: str | None = r"\d+"
    forbidden: str | None = None
    scored: bool = True


def audit_pairs(df: DataFrame, rules: PairRules, source: str = "source", targets: Sequence[str] = ("target_a", "target_b")) -> DataFrame:
    """AUD5: what each target lost of the source's force, a score and pass/fallback per row."""
    kept_columns = df.columns
    texts = {"src": F.coalesce(source, F.lit("")), **{t: F.coalesce(t, F.lit("")) for t in targets}}
    # every pattern runs once per text; the checks below only combine the flags
    found = {f"_m_{t}_{i}": text.rlike(r.source if t == "src" else r.target) for t, text in texts.items() for i, r in enumerate(rules.rules)}
    if rules.number:
        found |= {f"_n_{t}": F.regexp_extract_all(text, F.lit(rules.number), 0) for t, text in texts.items()}
    df = df.withColumns(found)
    none = F.array().cast("array<string>")
    made = {}
    for t in targets:
        checks = [F.when(F.trim(texts[t]) == "", F.lit("empty_target"))]
        if rules.forbidden:
            checks.append(F.when(texts[t].rlike(rules.forbidden), F.lit("forbidden_residual")))
        added = []
        for i, r in enumerate(rules.rules):
            has, kept = F.col(f"_m_src_{i}"), F.col(f"_m_{t}_{i}")
            checks.append(F.when(has & ~kept, F.lit(r.code)))
            if r.added:
                added.append(F.when(~has & kept, F.lit(r.added)))
        if rules.number:
            checks.append(F.when(~tx.multiset_covers(F.col(f"_n_{t}"), F.col("_n_src")), F.lit("numbers_not_preserved")))
        made[f"{t}_failures"] = F.array_compact(F.array(*checks))
        made[f"_{t}_w"] = F.array_compact(F.array(*added)) if added else none
    df = df.withColumns(made).select(*kept_columns, *made)
    union = reduce(F.array_union, [F.col(f"{t}_failures") for t in targets]) if len(targets) > 1 else F.array_distinct(f"{targets[0]}_failures")
    extra = reduce(F.array_union, [F.col(f"_{t}_w") for t in targets]) if len(targets) > 1 else F.array_distinct(f"_{targets[0]}_w")
    df = df.withColumns({"hard_failures": F.array_sort(union), "warnings": F.array_sort(extra)})
    loss = F.least(F.lit(75), F.size("hard_failures") * 25) + F.least(F.lit(25), F.size("warnings") * 5)
    return df.withColumns(
        {
            "score": F.greatest(F.lit(0), 100 - loss) / 100,
            "status": F.when(F.size("hard_failures") > 0, "fallback").otherwise("passed"),
            **{f"{t}_safe": F.size(f"{t}_failures") == 0 for t in targets},
        }
    ).drop(*[f"_{t}_w" for t in targets])


def meaning_flips(df: DataFrame, flags: dict[str, str], opposites: Sequence[tuple[str, str, str]], differs: Sequence[tuple[str, str]],
                  left: str = "text", right: str = "r_text", name: str = "risks") -> DataFrame:
    """Flip risks of two wordings: a flag on one side only, or opposite flags on the two sides."""
    def has(col: str, flag: str) -> Column:
        return F.coalesce(tx.compact(F.lower(F.col(col))).rlike(flags[flag]), F.lit(False))

    checks = [F.when(has(left, f) != has(right, f), F.lit(code)) for f, code in differs]
    checks += [
        F.when((has(left, a) & has(right, b)) | (has(left, b) & has(right, a)), F.lit(code)) for a, b, code in opposites
    ]
    return df.withColumn(name, F.array_sort(F.array_compact(F.array(*checks))))


def scene_audit(
    units: DataFrame, projections: DataFrame, rules: PairRules, max_cps: float = 20.0, max_line: int = 42,
    keys: Sequence[str] = ("stream_id", "scene"),
) -> DataFrame:
    """AUD6: issues per scene; a scene whose units and cues do not match one to one gets only that.

    ``units``: keys, ``seq, start_ms, end_ms, text``.  ``projections``: keys, ``seq, text, turn_ids``.
    Cues sharing the same turns are one alignment group for the surface checks.
    """
    keys = list(keys)
    unit = units.select(*keys, "seq", F.lit(1).alias("_u"))
    cues = projections.groupBy(*keys, "seq").agg(F.count("*").alias("_c"))
    bad = unit.join(cues, [*keys, "seq"], "full_outer").where("_u is null or _c is null or _c <> 1")
    bad = bad.select(*keys).distinct()
    coverage = bad.select(*keys, F.lit("").alias("members"), F.lit("unit_coverage").alias("code"), F.lit("error").alias("severity"))
    fine = projections.join(bad, keys, "left_anti").join(
        units.select(*keys, "seq", "start_ms", "end_ms", F.col("text").alias("source")), [*keys, "seq"]
    )
    text = F.col("text")
    speed = F.length(tx.compact(text)) * 1000.0 / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    cue = F.array_compact(
        F.array(
            F.when(text.rlike(CONTROL), finding("invalid_character", "error")),
            F.when(speed > max_cps, finding("reading_speed", "warning")),
            F.when(F.exists(tx.lines(text), lambda x: F.length(x) > max_line), finding("line_length", "warning")),
        )
    )
    cue_rows = fine.select(*keys, F.col("seq").cast("string").alias("members"), F.explode(cue).alias("i")).select(*keys, "members", "i.code", "i.severity")
    # an alignment group is the cues of a few turns; its size is bounded by the turn, not by the stream
    group = fine.groupBy(*keys, "turn_ids").agg(F.array_sort(F.collect_list(F.struct("seq", "source", "text"))).alias("g"))
    group = group.select(
        *keys, F.array_join(F.col("g.seq").cast("array<string>"), "+").alias("members"),
        F.array_join("g.source", " ").alias("source"), F.array_join("g.text", " ").alias("target"),
    )
    audited = audit_pairs(group, rules, "source", ("target",))
    review = audited.select(*keys, "members", F.explode("target_failures").alias("code"), F.lit("review").alias("severity"))
    return reduce(DataFrame.unionByName, [coverage, cue_rows, review]).dropDuplicates([*keys, "members", "code", "severity"])


def quality_class(codes: Column, unusable: Sequence[str], suspect: Sequence[str], explicit: Column | None = None) -> Column:
    """AUD7: unusable beats suspect beats trusted; an explicit status can only make it worse."""
    rank = F.when(F.arrays_overlap(codes, F.array(*map(F.lit, unusable))), 2).when(
        F.arrays_overlap(codes, F.array(*map(F.lit, suspect))), 1
    ).otherwise(0)
    if explicit is not None:
        named = F.when(explicit == "unusable", 2).when(explicit == "suspect", 1).otherwise(0)
        rank = F.greatest(rank, named)
    return F.when(rank == 2, "unusable").when(rank == 1, "suspect").otherwise("trusted")


@dataclass(frozen=True)
class RiskRules:
    question: str
    negation: str
    action: str
    long_chars: int = 42
    short_ms: int = 800
    short_chars: int = 10


def risk_band(df: DataFrame, rules: RiskRules, previous: str = "previous_text") -> DataFrame:
    """AUD8: additive risk score, its flags and the review band P1..P4."""
    text = F.col("text")
    solid = F.length(tx.compact(text))
    parts = [
        ("over_long", 22, solid > rules.long_chars),
        ("over_2_lines", 18, F.size(tx.lines(text)) > 2),
        ("question", 22, text.rlike(rules.question)),
        ("negation_or_refusal", 28, text.rlike(rules.negation)),
        ("action_or_location", 22, text.rlike(rules.action)),
        ("short_timing", 12, (F.col("end_ms") - F.col("start_ms") < rules.short_ms) & (solid > rules.short_chars)),
        ("duplicate", 10, F.coalesce((F.col(previous) != "") & (F.col(previous) == text), F.lit(False))),
    ]
    score = F.least(F.lit(100), reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for _, p, c in parts]))
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, _, c in parts]))
    df = df.withColumns({"risk_score": score.cast("long"), "risk_flags": flags})
    s = F.col("risk_score")
    return df.withColumn("band", F.when(s >= 72, "P1").when(s >= 45, "P2").when(s >= 28, "P3").otherwise("P4"))


def script_shares(df: DataFrame, classes: dict[str, str], keys: Sequence[str] = ("stream_id",), least: int = 4, share: float = 0.60) -> DataFrame:
    """AUD9: characters per script class, shares and the dominant class of each stream."""
    counts = df.groupBy(*keys).agg(*[F.sum(F.regexp_count("text", F.lit(rx))).cast("long").alias(n) for n, rx in classes.items()])
    total = reduce(lambda a, b: a + b, [F.col(n) for n in classes])
    counts = counts.withColumn("_total", total)
    top = F.lit(None).cast("string")
    for name in reversed(list(classes)):
        others = [F.col(o) for o in classes if o != name]
        rival = F.greatest(*others) if len(others) > 1 else (others[0] if others else F.lit(0))
        wins = (F.col(name) >= least) & (F.col(name) >= share * F.col("_total")) & (F.col(name) > rival)
        top = F.when(wins, F.lit(name)).otherwise(top)
    shares = {f"{n}_share": F.try_divide(F.col(n).cast("double"), F.col("_total")) for n in classes}
    return counts.withColumns({**shares, "dominant": top}).drop("_total")


def residual_counts(df: DataFrame, forbidden: str, columns: Sequence[str], keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AUD10: blocks, lines and characters matching a class, for each version column."""
    aggs = []
    for c in columns:
        hits = F.regexp_count(F.col(c), F.lit(forbidden))
        aggs += [
            F.count(F.when(hits > 0, 1)).alias(f"{c}_blocks"),
            F.sum(F.size(F.filter(tx.lines(F.col(c)), lambda x: x.rlike(forbidden)))).cast("long").alias(f"{c}_lines"),
            F.sum(hits).cast("long").alias(f"{c}_chars"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def reliable_evidence(df: DataFrame, banned: DataFrame | Sequence[str], min_logprob: float = -1.2, max_compression: float = 2.4) -> DataFrame:
    """AUD11: witness rows that are neither doubtful nor in the ban list of known hallucinations.

    A short Python list becomes a literal filter; a table becomes an anti-join whose strategy
    Spark picks from the table's size.
    """
    rows = df.where((F.col("avg_logprob") >= min_logprob) & (F.col("compression_ratio") <= max_compression))
    key = tx.word_key(F.col("text"))
    if isinstance(banned, DataFrame):
        ban = banned.select(tx.word_key(F.col("text")).alias("_ban")).distinct()
        return rows.join(ban, key == F.col("_ban"), "left_anti")
    return rows.where(~key.isin(*banned)) if banned else rows


def expectation_codes(outcome: str = "o") -> Column:
    """AUD12: codes an outcome earns against its case (columns of one joined row)."""
    text = F.coalesce("out_text", F.lit(""))
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.exists("required_text", lambda x: ~text.contains(x)), "missing_required_text"),
                F.when(F.exists("forbidden_text", lambda x: text.contains(x)), "forbidden_text"),
                F.when(F.col("required_register").isNotNull() & ~F.col("out_register").eqNullSafe(F.col("required_register")), "wrong_register"),
                F.when(F.size(F.array_except("required_refs", "out_refs")) > 0, "missing_reference"),
                F.when(F.col("must_abstain") & ~F.col("out_abstained"), "did_not_abstain"),
                F.when(F.col("out_families") < F.col("min_families"), "too_few_families"),
                F.when(F.col("out_cps") > F.col("max_cps"), "reading_speed"),
            )
        )
    )


def expectation_suite(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """AUD12: per case the codes found, the expected ones missed and whether the case holds."""
    joined = cases.join(outcomes, "case_id", "left").withColumn("found", expectation_codes())
    missed = F.array_sort(F.array_except("expected_codes", "found"))
    joined = joined.withColumn("missed", missed)
    ok = F.when(F.col("kind") == "good", F.size("found") == 0).otherwise((F.size("missed") == 0) & (F.size("found") > 0))
    return joined.withColumn("holds", ok & F.col("out_text").isNotNull())


def expectation_summary(suite: DataFrame) -> DataFrame:
    """AUD12 (verdict): hazards queued and missed, clean rows wrongly flagged; passes only if all hold."""
    hazard, clean = F.col("kind") == "bad", F.col("kind") == "good"
    return suite.agg(
        F.count(F.when(hazard, 1)).alias("hazards"),
        F.count(F.when(hazard & ~F.col("holds"), 1)).alias("missed_hazards"),
        F.count(F.when(clean, 1)).alias("clean"),
        F.count(F.when(clean & ~F.col("holds"), 1)).alias("clean_regressions"),
        F.bool_and("holds").alias("passed"),
    )
