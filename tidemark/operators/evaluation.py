"""Evaluation: budgets, win rates, gates, adjudication and unblinding; partial input gives no numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("stream_id", "seq")
# fixed value: two-sided 95 % quantile of the normal distribution
Z95 = 1.959963984540054


def times(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole)


def claim_check(decisions: DataFrame, reference: DataFrame | None, keys: Sequence[str] = KEYS, group: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG34: accepted rows against a reference; equality is unidentifiable without one."""
    rows = decisions.join(reference, list(keys), "left") if reference is not None else decisions.withColumn("ref_text", F.lit(None).cast("string"))
    ok = F.col("status") == "accepted"
    out = rows.groupBy(*group).agg(
        times(ok).alias("accepted"), times(ok & F.col("ref_text").isNotNull()).alias("compared"), times(ok & (F.col("ref_text") == F.col("source_text"))).alias("exact_matches")
    )
    claim = F.when(F.col("compared") == 0, "unidentifiable").when(F.col("exact_matches") == F.col("accepted"), "equal").otherwise("not_equal")
    return out.withColumns({"exact_rate": rate(F.col("exact_matches"), F.col("compared")), "claim": claim})


def budget_metrics(records: DataFrame, gold: DataFrame, budgets: Sequence[int] = (5, 10, 20), universe: Sequence[str] = ("universe",)) -> DataFrame:
    """AGG13: recall and precision at review budgets per universe, withheld unless everything reconciles.

    ``records``: universe, ``record_id, rank, label, error_type, severity``; ``gold``: universe,
    ``gold_positives``.  One aggregate checks the table, one more counts per budget.
    """
    u = list(universe)
    error = F.col("label") == "error"
    ids = records.groupBy(*u, "record_id").agg(F.count("*").alias("_c")).groupBy(*u).agg(F.max("_c").alias("_repeat"))
    health = records.groupBy(*u).agg(
        F.count("*").alias("n"), F.min("rank").alias("_lo"), F.max("rank").alias("_hi"), F.count_distinct("rank").alias("_ranks"),
        times(F.col("label").isNull() | ~F.col("label").isin("error", "no-error")).alias("_unlabelled"), times(error & (F.coalesce(F.trim("error_type"), F.lit("")) == "")).alias("_untyped"),
        times(error).alias("_positives"), times(error & (F.lower("severity") == "critical")).alias("critical_positives"),
    ).join(ids, u).join(gold, u, "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("gold_positives", F.lit(0)) < 1, "gold_missing"), F.when(F.col("_repeat") > 1, "duplicate_id"),
            F.when((F.col("_lo") != 1) | (F.col("_hi") != F.col("n")) | (F.col("_ranks") != F.col("n")), "ranks_not_consecutive"),
            F.when(F.col("_unlabelled") > 0, "unlabelled"), F.when(F.col("_untyped") > 0, "error_type_missing"),
            F.when(F.col("gold_positives") != F.col("_positives"), "gold_does_not_reconcile"),
        )
    )
    health = health.withColumn("reasons", reasons)
    rows = records.join(health.select(*u, "n"), u)

    def seen(b: int) -> Column:
        return F.col("rank") <= F.ceil(F.col("n") * b / 100)

    counts = rows.groupBy(*u).agg(
        *[times(seen(b) & error).alias(f"tp{b}") for b in budgets], *[times(seen(b) & error & (F.lower("severity") == "critical")).alias(f"cr{b}") for b in budgets]
    )
    out = health.join(counts, u).withColumn(
        "b", F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.least(F.col("n"), F.ceil(F.col("n") * b / 100)).alias("k"), F.col(f"tp{b}").alias("tp"), F.col(f"cr{b}").alias("cr")) for b in budgets]))
    )
    shown = F.size("reasons") == 0

    def maybe(c: Column) -> Column:
        return F.when(shown, c)

    return out.select(
        *u, F.col("b.budget").alias("budget"), maybe(F.col("b.k")).alias("reviewed"), maybe(F.col("b.tp")).alias("true_positive"), maybe(F.col("b.k") - F.col("b.tp")).alias("false_positive"),
        maybe(F.col("gold_positives") - F.col("b.tp")).alias("false_negative"), maybe(rate(F.col("b.tp"), F.col("gold_positives"))).alias("recall"),
        maybe(rate(F.col("b.tp"), F.col("b.k"))).alias("precision"), maybe(rate(F.col("b.cr"), F.col("critical_positives"))).alias("critical_recall"), "reasons",
    )


def budget_type_recall(records: DataFrame, budgets: Sequence[int] = (5, 10, 20), universe: Sequence[str] = ("universe",)) -> DataFrame:
    """AGG13 (per type): found and recall per error type and budget of a reconciled universe."""
    u = list(universe)
    rows = records.join(records.groupBy(*u).agg(F.count("*").alias("_n")), u).where("label = 'error'")
    out = rows.groupBy(*u, "error_type").agg(F.count("*").alias("gold"), *[times(F.col("rank") <= F.ceil(F.col("_n") * b / 100)).alias(f"f{b}") for b in budgets])
    out = out.withColumn("b", F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"f{b}").alias("found")) for b in budgets])))
    return out.select(*u, "error_type", "gold", "b.budget", "b.found", (F.col("b.found") / F.col("gold")).alias("recall"))


def wilson(wins: Column, trials: Column, upper: bool) -> Column:
    p = wins.cast("double") / trials
    base = 1 + Z95 * Z95 / trials
    centre = (p + Z95 * Z95 / (2 * trials)) / base
    margin = Z95 * F.sqrt((p * (1 - p) + Z95 * Z95 / (4 * trials)) / trials) / base
    edge = F.least(F.lit(1.0), centre + margin) if upper else F.greatest(F.lit(0.0), centre - margin)
    return F.when(trials > 0, edge)


def pairwise_metrics(scenes: DataFrame, candidate: str, comparator: str, group: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG14: wins and losses among scenes free of critical errors, Wilson interval, error rates over all.

    ``scenes``: group, ``choice`` and ``issues`` (array of struct candidate, severity, uncertain).
    """
    def has(who: str, severity: str | None = None) -> Column:
        def pred(x):
            hit = (x["candidate"] == who) & ~F.coalesce(x["uncertain"], F.lit(False))
            return hit & (x["severity"] == severity) if severity else hit

        return F.exists("issues", pred)

    rows = scenes.withColumns({"_cc": has(candidate, "critical"), "_oc": has(comparator, "critical"), "_cm": has(candidate, "major"), "_om": has(comparator, "major"), "_any": has(candidate)})
    good = ~F.col("_cc") & ~F.col("_oc")
    out = rows.groupBy(*group).agg(
        F.count("*").alias("scenes"), times(good).alias("qualified"), times(good & (F.col("choice") == candidate)).alias("wins"), times(good & (F.col("choice") == comparator)).alias("losses"),
        times(good & (F.col("choice") == "tie")).alias("ties"), times(F.col("_cc")).alias("_ccn"), times(F.col("_oc")).alias("_ocn"), times(F.col("_cm")).alias("_cmn"),
        times(F.col("_om")).alias("_omn"), times(F.col("_any")).alias("_anyn"),
    )
    trials = F.col("wins") + F.col("losses")
    return out.withColumns(
        {
            "win_rate": rate(F.col("wins"), trials), "win_low": wilson(F.col("wins"), trials, False), "win_high": wilson(F.col("wins"), trials, True),
            "loss_rate": rate(F.col("losses"), F.col("qualified")), "tie_rate": rate(F.col("ties"), F.col("qualified")),
            "candidate_critical_rate": rate(F.col("_ccn"), F.col("scenes")), "comparator_critical_rate": rate(F.col("_ocn"), F.col("scenes")),
            "candidate_major_rate": rate(F.col("_cmn"), F.col("scenes")), "comparator_major_rate": rate(F.col("_omn"), F.col("scenes")),
            "semantic_error_rate": rate(F.col("_anyn"), F.col("scenes")),
        }
    ).drop("_ccn", "_ocn", "_cmn", "_omn", "_anyn")


# --- three gates over adjudicated rows -------------------------------------------------------


def _completeness(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    pending = F.col("adjudication_status").isNull() | ~F.col("adjudication_status").isin("agreed", "adjudicated", "unresolved")
    return rows.groupBy(*group).agg(F.count("*").alias("n_rows"), times(pending).alias("pending"), times(F.col("adjudication_status") == "unresolved").alias("unresolved"))


def new_critical_errors(rows: DataFrame, errors: DataFrame, group: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG15: critical semantic errors of the improvement with no baseline match in the same row.

    ``errors``: group, ``seq, candidate, dimension, severity, error_type, refs``.
    """
    keys = [*group, "seq"]
    severe = errors.where("dimension = 'semantic_fidelity' and severity = 'critical'").select(
        *keys, "candidate", F.lower("error_type").alias("_type"), F.lower(F.array_join("refs", "\u0001")).alias("_refs")
    )
    base = severe.where("candidate = 'baseline'").select(*keys, "_type", "_refs").distinct()
    fresh = severe.where("candidate = 'improvement'").join(base, [*keys, "_type", "_refs"], "left_anti")
    counts = fresh.groupBy(*group).agg(F.count("*").alias("new_errors"), F.count_distinct("seq").alias("new_error_rows"))
    out = _completeness(rows, group).join(counts, list(group), "left")
    open_ = (F.col("pending") + F.col("unresolved")) > 0
    n = F.coalesce("new_errors", F.lit(0))
    return out.withColumns(
        {
            "new_errors": F.when(~open_, n), "new_error_rows": F.when(~open_, F.coalesce("new_error_rows", F.lit(0))),
            "status": F.when(open_, "awaiting").when(n == 0, "pass").otherwise("fail"),
        }
    )


def error_row_reduction(rows: DataFrame, errors: DataFrame, group: Sequence[str] = ("stream_id",), minimum_pct: int = 50) -> DataFrame:
    """AGG16: rows with a serious meaning or context error, before and after; integer comparison only."""
    bad = errors.where(F.col("dimension").isin("semantic_fidelity", "context") & F.col("severity").isin("critical", "major"))
    counts = bad.groupBy(*group).agg(
        *[F.count_distinct(F.when(F.col("candidate") == c, F.col("seq"))).alias(f"{c}_rows") for c in ("baseline", "improvement")]
    )
    out = _completeness(rows, group).join(counts, list(group), "left")
    b, i = F.coalesce("baseline_rows", F.lit(0)), F.coalesce("improvement_rows", F.lit(0))
    status = (
        F.when(F.col("pending") > 0, "awaiting").when(F.col("unresolved") > 0, "inconclusive").when(b == 0, "inconclusive")
        .when((b - i) * 100 >= b * minimum_pct, "pass").otherwise("fail")
    )
    shown = (F.col("pending") == 0) & (F.col("unresolved") == 0)
    return out.withColumns(
        {
            "baseline_rows": F.when(shown, b), "improvement_rows": F.when(shown, i),
            "reduction_rate": F.when(shown & (b > 0), (b - i).cast("double") / b), "status": status,
        }
    )


def fixed_preference(rows: DataFrame, group: Sequence[str] = ("stream_id",), win_pct: int = 65, loss_pct: int = 15) -> DataFrame:
    """AGG17: wins and losses over all rows; nonverbal counts as tie, unresolved stays in the denominator."""
    o = F.col("outcome")
    counts = rows.groupBy(*group).agg(times(o == "improvement").alias("wins"), times(o == "baseline").alias("losses"), times(o.isin("tie", "nonverbal")).alias("ties"))
    out = _completeness(rows, group).join(counts, list(group))
    enough = (F.col("wins") * 100 >= F.col("n_rows") * win_pct) & (F.col("losses") * 100 <= F.col("n_rows") * loss_pct)
    status = F.when(F.col("pending") > 0, "awaiting").when(F.col("unresolved") > 0, "inconclusive").when(enough, "pass").otherwise("fail")
    shown = F.col("pending") == 0
    return out.withColumns(
        {**{c: F.when(shown, F.col(c)) for c in ("wins", "losses", "ties")}, "win_rate": F.when(shown, F.col("wins") / F.col("n_rows")),
         "loss_rate": F.when(shown, F.col("losses") / F.col("n_rows")), "status": status}
    )


# fixed value: from most to least limiting
GATE_ORDER = ("awaiting", "inconclusive", "fail", "pass")


def combined_gate(gates: dict[str, DataFrame], group: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG18: the most limiting status of all gates; a later gate never offsets an earlier one."""
    tables = [df.select(*group, F.col("status").alias(name)) for name, df in gates.items()]
    out = reduce(lambda a, b: a.join(b, list(group), "full_outer"), tables)
    rank = F.array(*map(F.lit, GATE_ORDER))
    worst = F.least(*[F.coalesce(F.array_position(rank, F.coalesce(n, F.lit("awaiting"))), F.lit(1)) for n in gates])
    status = F.get(rank, (worst - 1).cast("int"))
    blockers = F.array_compact(F.array(*[F.when(~F.coalesce(n, F.lit("awaiting")).eqNullSafe(F.lit("pass")), F.concat_ws(":", F.lit(n), F.coalesce(n, F.lit("awaiting")))) for n in gates]))
    return out.withColumns({"gate": status, "blockers": blockers})


# fixed values: what a release needs, by the table that must show it
RELEASE_CHECKS = {
    "adjudicated_gold": ("gold_suite", "status = 'pass' and adjudicated_records > 0 and locked_test_records > 0"),
    "blind_human_review": ("blind_review", "evaluation_status = 'human-reviewed' and review_complete and reviewed_blocks > 0"),
    "p3_p4_audit": ("audit_summary", "review_complete and reviewed_blocks > 0"),
    "measured_review_efficiency": ("review_metrics", "metrics_status = 'demonstrated'"),
    "human_release_approval": ("release_approval", "approved and trim(approved_by) <> ''"),
    "sol_experiment": ("sol_experiment", "status = 'completed'"),
}


def release_gate(
    streams: DataFrame, evidence: dict[str, DataFrame], group: Sequence[str] = ("stream_id",), waived: Sequence[str] = ("sol_experiment",),
) -> DataFrame:
    """AGG18 (release): every independent check must be shown by its own table; none stands in for another.

    ``evidence`` holds tables by the names in ``RELEASE_CHECKS``, a row per stream; a missing table or row, a null, and a stream with
    several rows that don't all pass count as not shown.  ``waived`` checks are passed without evidence: the experiment is optional
    unless a policy asks for it, the approval may be waived as well.
    """
    out = streams.select(*group).distinct()
    for check, (table, rule) in RELEASE_CHECKS.items():
        if check in waived:
            out = out.withColumn(check, F.lit(True))
        elif table not in evidence:
            out = out.withColumn(check, F.lit(False))
        else:
            shown = evidence[table].groupBy(*group).agg(F.bool_and(F.coalesce(F.expr(rule), F.lit(False))).alias(check))
            out = out.join(shown, list(group), "left").withColumn(check, F.coalesce(check, F.lit(False)))
    missing = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in RELEASE_CHECKS]))
    return out.withColumn("missing", missing).withColumn("status", F.when(F.size("missing") == 0, "pass").otherwise("fail"))


def bundle_permissions(gates: DataFrame) -> DataFrame:
    """AGG18 (bundle): four gate columns (booleans) to four permissions, each needing all before it."""
    a, b, c, d = (F.coalesce(x, F.lit(False)) for x in ("structure_ok", "evidence_ok", "quality_ok", "review_ok"))
    return gates.withColumns({"may_stage": a, "may_draft": a & b, "may_package": a & b & c, "may_release": a & b & c & d})


# --- review tables ---------------------------------------------------------------------------


def adjudicate(first: DataFrame, second: DataFrame, consensus: DataFrame, key: DataFrame, fields: Sequence[str] = ("semantic_gate", "context_gate", "preference", "nonverbal"),
               keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG19: two independent reviews become one row; a dispute needs a consensus recorded by both.

    ``consensus`` adds ``recorded_by`` (array of two) and ``agreed``.  ``key`` has
    ``candidate_a_variant, candidate_b_variant``.  A/B codes are mapped back at the very end.
    """
    def pick(df: DataFrame, tag: str, extra: Sequence[str] = ()) -> DataFrame:
        return df.select(*keys, F.struct("decision_status", *fields).alias(tag), *extra)

    both = pick(first, "_a").join(pick(second, "_b"), list(keys))
    c = consensus.select(*keys, F.struct("decision_status", *fields).alias("_c"), (F.col("agreed") & (F.size(F.array_distinct("recorded_by")) == 2)).alias("_cok"))
    both = both.join(c, list(keys), "left").join(key, list(keys))
    same = F.col("_a").eqNullSafe(F.col("_b")) & (F.col("_a.decision_status") != "unresolved")
    settled = F.coalesce("_cok", F.lit(False))
    status = F.when(same, "agreed").when(settled, "adjudicated").otherwise("unresolved")
    chosen = F.when(same, F.col("_a")).when(settled, F.col("_c"))

    def back(value: Column) -> Column:
        return (
            F.when(value == "candidate-a", F.col("candidate_a_variant")).when(value == "candidate-b", F.col("candidate_b_variant"))
            .when(value == "a-only", F.concat("candidate_a_variant", F.lit("-only"))).when(value == "b-only", F.concat("candidate_b_variant", F.lit("-only"))).otherwise(value)
        )

    out = both.withColumns({"adjudication_status": status, "_x": chosen})
    values = {f: F.coalesce(back(F.col(f"_x.{f}").cast("string")), F.lit("unresolved")) for f in fields}
    return out.withColumns({**values, "stray_consensus": same & F.col("_c").isNotNull()}).drop("_a", "_b", "_c", "_cok", "_x", "candidate_a_variant", "candidate_b_variant")


def unblinded_choices(choices: DataFrame, key: DataFrame, keys: Sequence[str] = KEYS, group: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG20: variant counts per stream, only where choices and key cover the same rows exactly once."""
    from tidemark.operators.overlay import key_coverage

    bad = key_coverage(key, choices, keys).select(*group).distinct()
    ok = choices.join(bad, list(group), "left_anti").join(key, list(keys))
    variant = F.when(F.col("choice") == "a", F.col("candidate_a_variant")).when(F.col("choice") == "b", F.col("candidate_b_variant")).otherwise(F.col("choice"))
    counted = ok.groupBy(*group, variant.alias("variant")).agg(F.count("*").alias("chosen"))
    held = bad.select(*group, F.lit("withheld").alias("variant"), F.lit(None).cast("long").alias("chosen"))
    return counted.unionByName(held)


def judge_tallies(votes: DataFrame, keys: Sequence[str] = ("stream_id", "evaluator"), minimum: float = 0.90) -> DataFrame:
    """AGG21: wins, ties, losses per judge; passes with enough non-losses and no critical loss."""
    v = F.col("vote")
    out = votes.groupBy(*keys).agg(F.count("*").alias("n"), times(v == "win").alias("wins"), times(v == "tie").alias("ties"), times(v == "loss").alias("losses"),
                                   times((v == "loss") & F.col("critical")).alias("critical_losses"))
    ok = (F.col("wins") + F.col("ties") >= F.lit(minimum) * F.col("n")) & (F.col("critical_losses") == 0)
    return out.withColumn("passed", ok)


def condition_means(results: DataFrame, metrics: Sequence[str], group: Sequence[str] = ("condition",)) -> DataFrame:
    """AGG22: metric means per condition, null if any row of the condition does not validate."""
    valid = F.lit(True)
    for m in metrics:
        valid = valid & F.col(m).isNotNull() & (F.col(m) >= 0)
    rows = results.withColumn("_ok", valid)
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.bool_and("_ok").alias("valid"), *[F.avg(m).alias(f"avg_{m}") for m in metrics])
    return out.withColumns({f"avg_{m}": F.when(F.col("valid"), F.col(f"avg_{m}")) for m in metrics})


def split_leakage(rows: DataFrame, key: str = "stream_id") -> DataFrame:
    """AGG27: streams that occur in more than one split."""
    parts = rows.select(key, "split").distinct()
    return parts.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def label_set(rows: DataFrame, group: Sequence[str] = ("split",)) -> DataFrame:
    """AGG27 (labels): adjudicated and sealed rows per split."""
    return rows.groupBy(*group).agg(F.count("*").alias("n"), times(F.col("adjudicated")).alias("adjudicated"), times(F.col("sealed")).alias("sealed"))


def error_ledger(keys_df: DataFrame, errors: DataFrame, types: Sequence[str], severities: Sequence[str] = ("critical", "major", "minor", "neutral"), keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG28: complete ledger: every row, with its valid errors counted, worst severity and broken records."""
    good = F.col("error_type").isin(*types) & F.col("severity").isin(*severities) & (F.size("refs") > 0)
    rank = F.array_position(F.array(*map(F.lit, severities)), F.col("severity")).cast("int")
    per = errors.groupBy(*keys).agg(
        times(good).alias("errors"), times(good & (F.col("severity") == "critical")).alias("critical"), times(~F.coalesce(good, F.lit(False))).alias("invalid_records"), F.min(F.when(good, rank)).alias("_r")
    )
    out = keys_df.join(per, list(keys), "left")
    return out.withColumns(
        {**{c: F.coalesce(c, F.lit(0)) for c in ("errors", "critical", "invalid_records")}, "worst": F.coalesce(F.get(F.array(*map(F.lit, severities)), F.col("_r") - 1), F.lit("none"))}
    ).drop("_r")


def repair_scenes(findings: DataFrame, group: Sequence[str] = ("stream_id", "scene")) -> DataFrame:
    """AGG28 (repair list): scenes with a critic finding that is not dismissed and at least major."""
    need = F.col("severity").isin("critical", "major") & (F.col("disposition") != "dismissed")
    out = findings.groupBy(*group).agg(F.count("*").alias("findings"), times(need).alias("blocking"), times(F.col("disposition") == "dismissed").alias("dismissed"))
    return out.withColumn("needs_repair", F.col("blocking") > 0)


def audit_summary(sample: DataFrame, group: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG29: what an audit sample shows; descriptive only, and only when complete."""
    done = ~F.coalesce(F.col("review_result"), F.lit("")).isin("", "unreviewed")
    wrong = done & (F.coalesce(F.trim("mqm_error"), F.lit("")) != "")
    out = sample.groupBy(*group).agg(
        F.count("*").alias("sampled"), times(done).alias("reviewed"), times(~done).alias("unreviewed"), times(wrong).alias("error_findings"), times(wrong & (F.col("severity") == "critical")).alias("critical_findings")
    )
    return out.withColumn("metrics_status", F.when(F.col("unreviewed") == 0, "descriptive-only").otherwise("not-demonstrated"))
