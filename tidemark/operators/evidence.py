"""Evidence operators: one vote per source family, fusion, conflicts, arbitration and gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded
from tidemark.operators.audits import meaning_flips
from tidemark.operators.ordered import Order, chunk_width, chunked, context, running
from tidemark.session import materialise

UNVERIFIED = "unverified"


def canonical_family(label: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """First alias pattern that matches; every unknown label shares one family."""
    out = F.lit(UNVERIFIED)
    for name, pattern in reversed(list(aliases)):
        out = F.when(F.trim(label).rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(label.isNull(), F.lit(UNVERIFIED)).otherwise(out)


def family_votes(witness: DataFrame, aliases: Sequence[tuple[str, str]], keys: Sequence[str] = ("stream_id", "seq")) -> DataFrame:
    """AGG5: independent family count, families, declared labels and lineage status per key."""
    rows = witness.withColumn("_fam", canonical_family(F.col("family"), aliases))
    # (key, family, label) first: repeated witnesses never travel further than the map side
    slim = rows.groupBy(*keys, "_fam", F.trim("family").alias("_label")).agg(F.count("*").alias("_n"))
    known = F.collect_set(F.when(F.col("_fam") != UNVERIFIED, F.col("_fam")))
    return slim.groupBy(*keys).agg(
        F.array_sort(known).alias("families"), F.array_sort(F.collect_set(F.concat_ws("=", "_fam", "_label"))).alias("lineage"),
        F.sum("_n").alias("witnesses"), F.bool_or(F.col("_fam") == UNVERIFIED).alias("has_unverified"),
    ).withColumns(
        {
            "independent_families": F.size("families").cast("long"),
            "lineage_status": F.when(F.col("has_unverified"), "contains-unverified-family").otherwise("known-family-aliases-normalized"),
        }
    )


@dataclass(frozen=True)
class FlipRules:
    """Surface flags of a wording and which differences between two wordings are risks."""

    flags: dict[str, str]
    differs: tuple[tuple[str, str], ...] = ()
    opposites: tuple[tuple[str, str, str], ...] = ()


@F.pandas_udf(T.ArrayType(T.StringType()))
def shared_spans(left: pd.Series, right: pd.Series) -> pd.Series:
    """Common substrings of at least two characters along the best matching."""
    from difflib import SequenceMatcher

    def one(a, b):
        found = SequenceMatcher(None, a or "", b or "", autojunk=False).get_matching_blocks()
        return sorted({a[m.a:m.a + m.size] for m in found if m.size >= 2})

    return pd.Series([one(a, b) for a, b in zip(left, right)])


def witness_views(witness: DataFrame) -> DataFrame:
    """``_n``, the wording's key, with ``p`` (its place in time) and ``r`` (its rank among the family's single views)."""
    norm = tx.word_key(F.col("text"))
    span = F.col("end_ms") - F.col("start_ms")
    rank = F.struct(
        F.col("overlap_ms").alias("o"), F.col("confidence").alias("c"), (-F.abs(span)).alias("s"), norm.alias("n"),
        F.col("text").alias("t"), F.col("utterance_id").alias("u"),
    )
    return witness.withColumns({"_n": norm, "p": F.struct("start_ms", "end_ms", "utterance_id", F.col("text").alias("t")), "r": rank})


def family_hypotheses(witness: DataFrame, keys: Sequence[str] = ("stream_id", "seq")) -> DataFrame:
    """AGG6 (first half): one hypothesis per key and family.

    ``witness``: keys, ``family, text, tier`` (3 timestamp, 2 expanded, 1 window, 0 none), ``start_ms,
    end_ms, utterance_id, overlap_ms, confidence``.  The best tier of a family decides: tier 3 joins
    its distinct wordings in time order, lower tiers keep the single best view.
    """
    once = witness_views(witness).groupBy(*keys, "family", "tier", "_n").agg(F.min("p").alias("p"), F.max("r").alias("r"))
    return hypotheses_of(once, keys)


def hypotheses_of(once: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One hypothesis per key and family from one row per key, family, tier and wording."""
    spoken = F.when(F.col("_n") != "", F.col("p"))
    tiers = once.groupBy(*keys, "family", "tier").agg(
        F.array_sort(F.collect_list(spoken)).alias("parts"), F.max(F.when(F.col("_n") != "", F.col("r"))).alias("top")
    )
    best = tiers.groupBy(*keys, "family").agg(F.max_by(F.struct("parts", "top"), "tier").alias("b"), F.max("tier").alias("tier"))
    joined = F.array_join(F.transform("b.parts", lambda x: tx.squeeze(x["t"])), " ")
    single = F.coalesce(tx.squeeze(F.col("b.top.t")), F.lit(""))
    timed = F.col("tier") >= 3
    return best.select(
        *keys, "family", "tier", F.when(timed, joined).otherwise(single).alias("text"),
        F.when(timed, F.col("b.parts.utterance_id")).otherwise(F.array_compact(F.array("b.top.u"))).alias("refs"),
    ).withColumn("norm", tx.word_key(F.col("text")))


def fuse_witnesses(witness: DataFrame, rules: FlipRules, keys: Sequence[str] = ("stream_id", "seq"), similar: str = "bigram",
                   compatible_at: float = 0.55, spans: bool = False) -> DataFrame:
    """AGG6: agreement state of the families of each key, risks, similarities, alignment strength.

    The pairs compared are pairs of *families* of one key, whose number the alias list bounds.
    """
    return judge_hypotheses(family_hypotheses(witness, keys), witness.select(*keys).distinct(), rules, keys, similar, compatible_at, spans)


def judge_hypotheses(hypotheses: DataFrame, universe: DataFrame, rules: FlipRules, keys: Sequence[str], similar: str = "bigram",
                     compatible_at: float = 0.55, spans: bool = False) -> DataFrame:
    """AGG6 (second half): how the families of each key of ``universe`` agree."""
    keys = list(keys)
    hyp = hypotheses.where("norm <> ''")
    per = hyp.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("family", "text", "norm"))).alias("h"), F.min("tier").alias("_min"),
        F.array_sort(F.collect_list(F.struct("family", "refs"))).alias("family_refs"),
    )
    grid = F.flatten(
        F.transform("h", lambda a, i: F.transform(F.slice(F.col("h"), i + 2, F.size("h")), lambda b: F.struct(a.alias("l"), b.alias("r"))))
    )
    pairs = per.where(F.size("h") > 1).select(*keys, F.explode(grid).alias("p")).select(
        *keys, F.col("p.l.family").alias("lf"), F.col("p.r.family").alias("rf"), F.col("p.l.text").alias("text"), F.col("p.r.text").alias("r_text"),
        F.col("p.l.norm").alias("ln"), F.col("p.r.norm").alias("rn"),
    )
    pairs = meaning_flips(pairs, rules.flags, rules.opposites, rules.differs)
    pairs = pairs.withColumn("sim", tx.similarity(similar, F.col("ln"), F.col("rn")))
    exact = F.col("ln") == F.col("rn")
    close = F.col("ln").contains(F.col("rn")) | F.col("rn").contains(F.col("ln")) | (F.col("sim") >= compatible_at)
    fits = (F.size("risks") == 0) & (exact | ((F.least(F.length("ln"), F.length("rn")) >= 2) & close))
    aggs = [
        F.bool_and(exact).alias("_exact"), F.bool_and(fits).alias("_fits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("risks")))).alias("risk_codes"),
        F.min("sim").alias("min_similarity"),
        F.array_sort(F.collect_list(F.struct("lf", "rf", rounded("sim", 6).alias("similarity")))).alias("pairwise"),
    ]
    if spans:
        pairs = pairs.withColumn("_sp", shared_spans(F.col("ln"), F.col("rn")))
        aggs.append(F.collect_list("_sp").alias("_spans"))
    judged = pairs.groupBy(*keys).agg(*aggs)
    if spans:
        common = F.aggregate(F.slice("_spans", 2, F.size("_spans")), F.get("_spans", 0), lambda acc, x: F.array_intersect(acc, x))
        judged = judged.withColumn("shared_spans", F.array_sort(common)).drop("_spans")
    out = universe.join(per, keys, "left").join(judged, keys, "left")
    state = (
        F.when(F.col("h").isNull(), "empty").when(F.size("h") == 1, "single_family").when(F.size("risk_codes") > 0, "dual_conflict")
        .when(F.col("_exact"), "dual_agreement").when(F.col("_fits"), "dual_compatible").otherwise("dual_conflict")
    )
    strength = F.when(F.col("_min").isNull(), "none").when(F.col("_min") >= 3, "block-aligned").when(F.col("_min") >= 2, "expanded").otherwise("context-only")
    return out.withColumns(
        {
            "state": state, "alignment_strength": strength, "risk_codes": F.coalesce("risk_codes", F.array()),
            "families": F.coalesce(F.col("h.family"), F.array()), "texts": F.coalesce(F.col("h.text"), F.array()),
        }
    ).drop("h", "_min", "_exact", "_fits")


def confirmed_conflicts(entries: DataFrame, key_cols: Sequence[str], confirmed: Sequence[str] = ("confirmed", "approved")) -> DataFrame:
    """AGG7: declared keys with more than one distinct confirmed value (unknowns never conflict)."""
    ok = entries.where(F.col("status").isin(*confirmed) & F.col("value").isNotNull() & ~F.lower("value").isin("", "unknown"))
    values = ok.groupBy(*key_cols, "value").agg(F.count("*").alias("_n"))
    return values.groupBy(*key_cols).agg(F.array_sort(F.collect_set("value")).alias("values"), F.sum("_n").alias("entries")).where(F.size("values") > 1)


def withhold_conflicts(entries: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """AGG7 (use): entries with a flag whether their key is in conflict."""
    bad = confirmed_conflicts(entries, key_cols).select(*key_cols, F.lit(True).alias("_bad"))
    return entries.join(bad, list(key_cols), "left").withColumn("in_conflict", F.coalesce("_bad", F.lit(False))).drop("_bad")


# fixed values: the slots whose declared values must not differ between passes
CRITICAL_SLOTS = (
    "polarity", "interrogative", "request_strength", "permission", "prohibition", "actor", "target", "location", "completion_state", "sexual_semantic_class", "speaker",
)


def slot_conflicts(rows: DataFrame, claims: str = "slots", keys: Sequence[str] = ("stream_id", "scene"), critical: Sequence[str] = CRITICAL_SLOTS) -> DataFrame:
    """AGG8 (slots): per key the critical slots for which several confirmed values are declared.

    ``claims`` is JSON text without a schema: slot names with a ``state`` and a ``value``, next to anything else.  It is read as a
    variant; text that is no JSON, claims that are no objects, and unconfirmed, missing or empty values claim nothing.
    """
    read = rows.select(*keys, F.try_parse_json(claims).alias("_v")).where("_v is not null")
    get = lambda n, f: F.try_variant_get("_v", f"$.{n}.{f}", "string")
    told = F.array(*[F.struct(F.lit(n).alias("slot"), get(n, "state").alias("state"), F.trim(get(n, "value")).alias("value"), (get(n, "value") != "").alias("set")) for n in critical])
    said = read.select(*keys, F.explode(F.filter(told, lambda c: (c["state"] == "confirmed") & c["set"])).alias("c"))
    values = said.select(*keys, "c.slot", "c.value").distinct()
    several = values.groupBy(*keys, "slot").agg(F.count("*").alias("n")).where("n > 1")
    return several.groupBy(*keys).agg(F.array_sort(F.collect_list("slot")).alias("conflicts"))  # at most one entry per critical slot


def pass_pairs(rows: DataFrame, base: tuple[str, str], extra: Sequence[str], keys: Sequence[str] = ("stream_id", "scene"), similar: str = "bigram") -> DataFrame:
    """AGG8: escalation reasons and verdict of a scene from two base passes and optional extra ones.

    ``rows``: keys, ``profile, text, avg_logprob, no_speech_prob, error``, one row per profile, and
    perhaps ``slots``, whose conflicts are reasons as well.
    """
    def one(profile: str) -> Column:
        return F.max(F.when(F.col("profile") == profile, F.struct(F.trim("text").alias("t"), "avg_logprob", "no_speech_prob", "error")))

    left, right = base
    out = rows.groupBy(*keys).agg(
        one(left).alias("l"), one(right).alias("r"), F.bool_or(F.col("profile").isin(*extra) & (F.trim("text") != "")).alias("_extra"),
        F.bool_and(F.when(F.col("profile").isin(*base), F.coalesce("error", F.lit("")) != "")).alias("_all_err"),
    )
    lt, rt = F.coalesce("l.t", F.lit("")), F.coalesce("r.t", F.lit(""))
    out = out.withColumns({"_a": tx.word_key(lt), "_b": tx.word_key(rt)})
    out = out.withColumn("similarity", tx.similarity(similar, F.col("_a"), F.col("_b")))
    either = lambda c: F.coalesce(c(F.col("l")), F.lit(False)) | F.coalesce(c(F.col("r")), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when((lt == "") | (rt == ""), "empty"), F.when(F.col("similarity") < 0.82, "disagree"),
            F.when(either(lambda x: x["avg_logprob"] < -1.0), "low_logprob"), F.when(either(lambda x: x["no_speech_prob"] > 0.60), "high_no_speech"),
            F.when(either(lambda x: F.coalesce(x["error"], F.lit("")) != ""), "error"),
        )
    )
    if "slots" in rows.columns:
        out = out.join(slot_conflicts(rows, "slots", keys), list(keys), "left")
        reasons = F.concat(reasons, F.transform(F.coalesce("conflicts", F.array().cast("array<string>")), lambda s: F.concat(F.lit("semantic_conflict:"), s)))
    blank = (lt == "") & (rt == "")
    verdict = (
        F.when(blank & F.coalesce("_all_err", F.lit(True)), "unresolved").when(blank, "nonverbal")
        .when((lt != "") & (rt != "") & (F.col("similarity") >= 0.92), "stable").when((lt != "") & (rt != "") & (F.col("similarity") >= 0.75), "normalized")
        .when(F.col("_extra"), "context-resolved").otherwise("unresolved")
    )
    return out.withColumns({"reasons": F.array_sort(reasons), "verdict": verdict, "escalate": F.size(reasons) > 0}).drop("l", "r", "_a", "_b", "_extra", "_all_err", "conflicts")


# fixed values: the thirteen slots and the groups the arbitration treats differently
SLOTS = (
    "speech_act", "question", "polarity", "refusal_permission", "command_strength", "speaker", "actor",
    "action", "target", "location", "tense_aspect", "direction", "intensity",
)
FLIPPING = ("speech_act", "question", "polarity", "refusal_permission", "command_strength")
STRUCTURAL = ("speaker", "actor", "action", "target")
OPPOSITE_DIRECTIONS = (("toward", "away"), ("in", "out"), ("up", "down"), ("stop", "continue"))
COMPLETED = ("past", "completed")
NOT_COMPLETED = ("present", "future", "progressive")
FORCEFUL = ("command", "prohibition", "refusal")
SELF_CONTAINED = ("refusal", "prohibition", "response", "vocalization", "nonverbal")
WITH_ACTION = ("statement", "question", "request", "command", "permission")
CORE_SLOTS = ("speech_act", "question", "polarity", "refusal_permission", "command_strength", "action")
DETAIL_SLOTS = ("speaker", "actor", "action", "target", "location", "tense_aspect", "direction")


def plain(value: Column) -> Column:
    return F.nullif(tx.squeeze(F.lower(value)), F.lit(""))


def slot_value(slot: Column, value: Column) -> Column:
    """Unknowns (of a ``plain`` value) are not evidence; some slots also have a neutral word."""
    void = (value == "unknown") | (slot.isin("refusal_permission", "command_strength") & (value == "none")) | ((slot == "polarity") & (value == "neutral"))
    return F.when(~void, value)


def _supported(side: str) -> Column:
    """Independent support of one side's value: a cited trusted source, or two aligned families."""
    basis, refs = F.col(f"{side}.basis"), F.coalesce(F.col(f"{side}.refs"), F.array().cast("array<string>"))
    source = (F.col("source_quality") == "trusted") & F.array_contains(refs, F.col("source_ref"))
    strict = F.col("slot").isin(*FLIPPING, *STRUCTURAL)
    aligned = (F.col("alignment_strength") == "block-aligned") | (~strict & (F.col("alignment_strength") == "expanded"))
    dual = F.col("_dual") & aligned & (F.size(refs) > 0) & F.forall("fusion_refs", lambda r: F.arrays_overlap(r, refs))
    return F.coalesce(F.when(basis == "source-text", source).when(basis == "dual-asr", dual), F.lit(False))


def _blocking() -> Column:
    """Whether an unresolved difference of this slot can turn the meaning around."""
    slot, a, b = F.col("slot"), F.col("l"), F.col("r")
    turn = F.lit(False)
    for p, q in OPPOSITE_DIRECTIONS:
        turn = turn | ((a == p) & (b == q)) | ((a == q) & (b == p))
    aspect = (a.isin(*COMPLETED) & b.isin(*NOT_COMPLETED)) | (b.isin(*COMPLETED) & a.isin(*NOT_COMPLETED))
    apart = ((a == "low") & (b == "high")) | ((a == "high") & (b == "low"))
    return (
        F.when(slot.isin(*FLIPPING, "action"), True).when(slot == "direction", turn).when(slot == "tense_aspect", aspect)
        .when(slot == "intensity", apart & F.col("_force")).otherwise(False)
    )


def _minimal(act: Column, action: Column) -> Column:
    return F.coalesce(act.isin(*SELF_CONTAINED) | (act.isin(*WITH_ACTION) & action.isNotNull()), F.lit(False))


def arbitrate_slots(frames: DataFrame, keys: Sequence[str] = ("stream_id", "seq")) -> DataFrame:
    """AGG9: two annotators' slots settled per slot, without ever preferring an annotator.

    ``frames``: keys, ``left_<slot>`` and ``right_<slot>`` for the 13 slots, ``left_support`` /
    ``right_support`` (map slot -> struct(basis, refs)), ``source_quality, source_ref, fusion_state,
    alignment_strength, fusion_refs`` (one ref array per family), ``context_retried``.  Slots are
    unpivoted to 13 short rows; those of a key sit together, so the regrouping combines map-side
    and one row per key is shuffled.
    """
    slots = F.array(
        *[
            F.struct(F.lit(s).alias("slot"), F.col(f"left_{s}").alias("l"), F.col(f"right_{s}").alias("r"))
            for s in SLOTS
        ]
    )
    ctx = ["source_quality", "source_ref", "fusion_state", "alignment_strength", "fusion_refs", "context_retried"]

    # the three slots that decide about force, plain once per side
    deciding = ("command_strength", "speech_act", "refusal_permission")
    rows = frames.select(
        *keys, *ctx, "left_support", "right_support", slots.alias("_x"), *[plain(F.col(f"{side}_{s}")).alias(f"_{side}_{s}") for side in ("left", "right") for s in deciding]
    )
    strengths = [slot_value(F.lit("command_strength"), F.col(f"_{side}_command_strength")) for side in ("left", "right")]
    force = F.lit(False)
    for side in ("left", "right"):
        force = force | F.coalesce(F.col(f"_{side}_speech_act").isin(*FORCEFUL), F.lit(False))
        force = force | F.coalesce(F.col(f"_{side}_refusal_permission").isin("refusal", "permission", "prohibition"), F.lit(False))
    rows = rows.select(
        *keys, "source_quality", "source_ref", "alignment_strength", "fusion_refs", "context_retried", "left_support", "right_support",
        (F.col("fusion_state").isin("dual_agreement", "dual_compatible") & (F.size("fusion_refs") >= 2)).alias("_dual"),
        (~F.coalesce(strengths[0] == strengths[1], F.lit(False)) & force).alias("_force"), F.explode("_x").alias("x"),
    )
    # supports are looked up after the explode: one lookup per side keeps the generated code small
    rows = rows.select(
        *[c for c in rows.columns if c not in ("x", "left_support", "right_support")], "x.slot", plain(F.col("x.l")).alias("_l"), plain(F.col("x.r")).alias("_r"),
        F.col("left_support")[F.col("x.slot")].alias("lb"), F.col("right_support")[F.col("x.slot")].alias("rb"),
    )
    rows = rows.select(
        *keys, "context_retried", "_force", "slot", slot_value(F.col("slot"), F.col("_l")).alias("l"), slot_value(F.col("slot"), F.col("_r")).alias("r"),
        _supported("lb").alias("ls"), _supported("rb").alias("rs"),
    )
    a, b = F.col("l"), F.col("r")
    left, right = F.col("ls") & ~F.col("rs"), F.col("rs") & ~F.col("ls")
    how = (
        F.when(a.isNull() & b.isNull(), "absent").when(a.eqNullSafe(b), "dual_agreement")
        .when(a.isNotNull() & left, "left_only_supported").when(b.isNotNull() & right, "right_only_supported")
        .when(a.isNull() | b.isNull(), "absent").when(_blocking(), "conflict_blocking").otherwise("conflict_omitted")
    )
    rows = rows.withColumn("p", how)
    pick = F.when(F.col("p").isin("dual_agreement", "left_only_supported"), a).when(F.col("p") == "right_only_supported", b)
    rows = rows.withColumn("s", pick)
    # one collected array per key; every list below is a filter of its 13 entries
    entry = F.struct(
        "slot", "p", "s", (a.isNotNull() & b.isNotNull() & (a != b)).alias("c"), (a.isNull() != b.isNull()).alias("g")
    )
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_v"), F.bool_or("context_retried").alias("_retried"))

    def listed(pred) -> Column:
        return F.filter("_v", pred)["slot"]

    def single(x: Column) -> Column:
        return x["p"].isin("left_only_supported", "right_only_supported")

    by_name = {s: i for i, s in enumerate(sorted(SLOTS))}

    def value(s: str) -> Column:
        return F.get("_v", by_name[s])["s"]

    per = per.select(
        *keys, "_retried", listed(lambda x: F.coalesce(x["c"], F.lit(False))).alias("conflicts"), listed(lambda x: x["g"]).alias("coverage_gaps"),
        listed(lambda x: x["p"] == "conflict_blocking").alias("blocking"), listed(lambda x: F.coalesce(x["c"], F.lit(False)) & single(x)).alias("resolved"),
        F.exists("_v", single).alias("_single"), F.transform(F.filter("_v", lambda x: x["s"].isNotNull()), lambda x: F.struct(x["slot"].alias("slot"), x["s"].alias("s"))).alias("_sel"),
        F.transform("_v", lambda x: F.struct(x["slot"].alias("slot"), x["p"].alias("p"))).alias("_prov"),
        *[value(s).alias(f"_{n}") for n, s in (("act", "speech_act"), ("q", "question"), ("rp", "refusal_permission"), ("cs", "command_strength"), ("do", "action"))],
    )
    # coherence of the selected frame
    act, question, rp, strength = F.col("_act"), F.col("_q"), F.col("_rp"), F.col("_cs")
    ask = ((question == "true") & act.isNotNull() & ~act.isin("question", "request")) | ((act == "question") & (question == "false"))
    fits = (
        F.when(rp == "refusal", act.isin("refusal", "response")).when(rp == "permission", act.isin("permission", "response"))
        .when(rp == "prohibition", act.isin("prohibition", "command", "response"))
    )
    strong = strength.isin("suggestion", "request", "command", "urgent") & act.isNotNull() & ~act.isin("request", "command", "prohibition")
    nonlexical = F.coalesce(act.isin("vocalization", "nonverbal"), F.lit(False))
    per = per.withColumns(
        {
            "_f1": F.coalesce(ask, F.lit(False)), "_f2": F.coalesce(act.isNotNull() & ~fits, F.lit(False)), "_f3": F.coalesce(strong, F.lit(False)),
            "_f4": nonlexical & F.arrays_overlap("_sel.slot", F.array(*map(F.lit, DETAIL_SLOTS))),
        }
    )
    kept = F.filter(
        "_sel", lambda x: ~((F.col("_f4") & x["slot"].isin(*DETAIL_SLOTS)) | (F.col("_f3") & (x["slot"] == "command_strength")))
    )
    per = per.withColumn("_kept", kept)
    per = per.withColumn("_empty", ~F.arrays_overlap("_kept.slot", F.array(*map(F.lit, CORE_SLOTS))))
    findings = F.array_compact(
        F.array(
            F.when(F.col("_f1"), "question-speech-act-mismatch"), F.when(F.col("_f2"), "refusal-permission-speech-act-mismatch"),
            F.when(F.col("_f3"), "command-strength-speech-act-mismatch"), F.when(F.col("_f4"), "nonlexical-frame-retains-semantic-detail"),
            F.when(F.col("_empty"), "empty-semantic-core"),
        )
    )
    per = per.withColumns(
        {
            "findings": findings, "_high": F.col("_f1") | F.col("_f2") | F.col("_empty"), "_blocked": F.size("blocking") > 0,
            "minimal_available": _minimal(act, F.when(~F.col("_f4"), F.col("_do"))),
        }
    )
    blocked, minimal = F.col("_blocked"), F.col("minimal_available")
    flipping = F.arrays_overlap("blocking", F.array(*map(F.lit, FLIPPING)))
    state = (
        F.when(nonlexical & ~blocked, "vocalization").when(blocked & ~F.col("_high") & ~flipping & minimal, "minimal_speech_act")
        .when(blocked | F.col("_high"), "abstained").when(F.col("_single"), "recovered_single_model").when(F.col("_retried"), "recovered_context")
        .when((F.size("conflicts") == 0) & (F.size("coverage_gaps") == 0), "accepted_consensus").when(minimal, "accepted_partial").otherwise("abstained")
    )
    return per.select(
        *keys, state.alias("state"), "conflicts", "coverage_gaps", "blocking", "resolved", F.array_sort("_kept.slot").alias("rendered"), "findings",
        F.map_from_entries("_kept").alias("selected"), F.map_from_entries("_prov").alias("provenance"), "minimal_available",
    )


def route_utterance(df: DataFrame) -> DataFrame:
    """AGG10: lexical wins; otherwise two of three independent signals must agree.

    Needs ``source_kind, source_trusted, meaningful_short, frame_kind, fusion_kind``.
    """
    usable = F.when(F.col("source_trusted") & ~F.col("source_kind").isin("corrupt", "empty"), F.col("source_kind")).otherwise("unknown")
    lexical = (F.col("source_trusted") & F.col("meaningful_short")) | (F.col("frame_kind") == "lexical") | (F.col("fusion_kind") == "lexical")

    def votes(kind: str) -> Column:
        return sum([(c == kind).cast("int") for c in (usable, F.col("frame_kind"), F.col("fusion_kind"))], F.lit(0))

    kind = F.when(lexical, "lexical_speech").when(votes("vocalization") >= 2, "vocalization").when(votes("nonverbal") >= 2, "nonverbal").otherwise("unknown")
    sure = F.col("source_trusted") & (F.col("source_kind") == "lexical") & (F.col("frame_kind") == "lexical")
    level = (
        F.when(lexical, F.when(sure, "high").otherwise("medium"))
        .when(kind != "unknown", F.when(F.col("fusion_kind") == kind, "high").otherwise("medium")).otherwise("low")
    )
    return df.withColumns({"utterance_kind": kind, "confidence": level})


def usable_dual() -> Column:
    """Two families, compatible, aligned to the block, no open risk."""
    aligned = (F.col("alignment_strength") == "block-aligned") | (
        (F.col("alignment_strength") == "expanded") & (F.col("block_alignment_status") == "single-block-expanded")
    )
    return (F.size("families") >= 2) & F.col("state").isin("dual_agreement", "dual_compatible") & aligned & (F.size("risk_codes") == 0)


def evidence_ceiling(rows: DataFrame, required_rate: float, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG11: best reachable acceptance rate per stream against the required one."""
    eligible = (F.col("source_quality") == "trusted") | usable_dual()
    out = rows.groupBy(*keys).agg(F.count("*").alias("segments"), F.count(F.when(eligible, 1)).alias("eligible"))
    return out.withColumns(
        {"max_rate": F.col("eligible") / F.col("segments"), "allowed": F.col("eligible") >= F.lit(required_rate) * F.col("segments")}
    )


def decide_candidates(
    candidates: DataFrame, segments: DataFrame, keys: Sequence[str] = ("stream_id", "seq"), not_generated: Sequence[str] = ("previous", "unprovenanced"),
    agree_at: float = 0.72, similar: str = "bigram",
) -> DataFrame:
    """AGG12: accept a candidate only when no reason speaks against it, else abstain with reasons.

    ``candidates``: keys, ``family, role, path, text, errors`` (array).  ``segments``: keys and
    ``reasons`` (array) already known.  Families stand for themselves once, whatever they submitted.
    """
    keys = list(keys)
    ok = candidates.where(F.size("errors") == 0)
    order = F.struct((F.col("role") != "source-faithful").alias("a"), (F.col("role") == "previous").alias("b"), F.col("path").alias("p"))
    reps = ok.groupBy(*keys, "family").agg(
        F.min_by("text", order).alias("text"),
        F.min_by("text", F.when(F.col("role") == "source-faithful", F.col("path"))).alias("source_text"),
        F.min_by("text", F.when(F.col("role") == "viewer-natural", F.col("path"))).alias("viewer_text"),
        F.min_by("text", F.col("path")).alias("first_text"),
    )
    made = ~F.col("family").isin(*not_generated)
    source = F.coalesce("source_text", "first_text")
    per = reps.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("family", tx.word_key(F.col("text")).alias("norm")))).alias("h"),
        F.count("*").alias("families"), F.count(F.when(made, 1)).alias("generated"),
        F.min(F.when(made, F.struct("family", source.alias("s"), F.coalesce("viewer_text", source).alias("v")))).alias("pick"),
    )
    grid = F.flatten(F.transform("h", lambda a, i: F.transform(F.slice(F.col("h"), i + 2, F.size("h")), lambda b: F.struct(a["norm"].alias("l"), b["norm"].alias("r")))))
    sims = per.where(F.size("h") > 1).select(*keys, F.explode(grid).alias("p")).select(*keys, F.col("p.l").alias("l"), F.col("p.r").alias("r"))
    sims = sims.withColumn("sim", tx.similarity(similar, F.col("l"), F.col("r"))).groupBy(*keys).agg(F.min("sim").alias("min_similarity"))
    out = segments.join(per, keys, "left").join(sims, keys, "left")
    made_n = F.coalesce("generated", F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(made_n == 0, "no-generated-candidate"), F.when(made_n < 2, "insufficient-generated-families"),
            F.when(F.col("min_similarity") < agree_at, "candidate-family-disagreement"),
        )
    )
    out = out.withColumn("reasons", F.array_sort(F.array_union(F.coalesce("reasons", F.array().cast("array<string>")), reasons)))
    good = F.size("reasons") == 0
    return out.withColumns(
        {
            "status": F.when(good, "accepted").otherwise("abstained"), "selected_family": F.when(good, F.col("pick.family")),
            "source_text": F.when(good, F.col("pick.s")).otherwise(""), "viewer_text": F.when(good, F.col("pick.v")).otherwise(""),
            "families": F.coalesce("families", F.lit(0)),
        }
    ).drop("h", "pick", "generated")


FAN = 16
# spread(): rows and members of a class that meet in one tile, and the rows that a task makes
TILE = 2048
MADE = 4_000_000


def _covering(low: Column, high: Column, levels: int) -> Column:
    """Blocks (level, number) of FAN, FAN**2 ... rows that together hold just the rows from ``low`` to ``high``; at most 2 * FAN a level."""
    out = []
    for level in range(levels):
        run = lambda a, b, level=level: F.when(a <= b, F.transform(F.sequence(F.least(a, b), b), lambda i: F.struct(F.lit(level).alias("level"), i.alias("block")))).otherwise(
            F.array().cast("array<struct<level:int,block:bigint>>"))
        if level == levels - 1:
            out.append(run(low, high))
            break
        left = F.when(low % FAN != 0, F.least(high, low - low % FAN + FAN - 1)).otherwise(low - 1)
        right = F.when((high % FAN != FAN - 1) & (left < high), F.greatest(left + 1, high - high % FAN)).otherwise(high + 1)
        out += [run(low, left), run(right, high)]
        low, high = F.ceil((left + 1) / F.lit(float(FAN))).cast("long"), (F.floor(right / FAN) - 1).cast("long")
    return F.concat(*out)


def ledger_classes(
    ledger: DataFrame, segments: DataFrame, speakers: DataFrame, keys: Sequence[str] = ("stream_id", "seq"),
) -> tuple[DataFrame, DataFrame]:
    """JOIN12 by classes: what ``apply_ledger`` gives for the first segment of each class, and (keys, ``_first``) for every segment.

    Segments of a stream are one class if no range of the stream's entries starts or ends between them and they show the same scenes, speaker and
    addressee: the same entries apply to them.  Entries meet classes on the stream, on what their scope names and on a block: a range is cut
    into a few blocks of 1, 16, 256 ... positions, a class names the block it lies in at each size.  Entries without a range have one block, the
    whole stream.  No join may broadcast: a table's size on disk says little about its rows.
    """
    keys = list(keys)
    stream, at = keys
    ends = segments.agg(F.min(at).cast("long").alias("low"), F.max(at).cast("long").alias("high")).first()
    bottom, top = F.lit(ends["low"] or 0), F.lit(ends["high"] or 0)
    starts, stops = F.col("start_block").cast("long"), F.col("end_block").cast("long")
    # a bound that no segment lies beyond is no bound
    entries = ledger.where(F.col("status").isin("confirmed", "candidate", "unresolved") & F.coalesce(starts <= top, F.lit(True)) & F.coalesce(stops >= bottom, F.lit(True)))
    entries = entries.withColumns({"_low": F.when(starts > bottom, starts - bottom), "_high": F.when(stops < top, stops - bottom)})
    held = entries.agg(F.count("*").alias("n"), F.greatest(F.max("_low"), F.max("_high") + 1).alias("last")).first()
    last, levels, tasks = held["last"] or 0, 1, -(-held["n"] // 50_000) or 1
    while FAN**levels <= last:
        levels += 1

    # each segment's names, and the last position up to its own at which some entry of its stream starts or has ended
    name = lambda kind, *parts: F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts])
    scenes = lambda ids: F.transform(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda s: s.isNotNull()), lambda s: name("scene", s))
    shown = segments.where(F.col(at).isNotNull()).select(*keys, F.concat(F.array(F.lit("all")), scenes(F.col("scene_ids"))).alias("_names"), F.lit(True).alias("_own"))
    said = speakers.where("trusted").select(
        *keys, F.array(name("speaker", F.col("speaker_id")), name("relationship", F.col("speaker_id"), F.col("addressee_id"))).alias("_names"), F.lit(False).alias("_own"))
    places = shown.unionByName(said).groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_names")))).alias("_names"), F.max("_own").alias("_own")).where("_own")
    if last:
        cuts = entries.select(stream, F.explode(F.array_compact(F.array("_low", F.col("_high") + 1))).alias("_cut")).distinct()
        cuts = cuts.select(stream, (F.col("_cut") + bottom).alias(at), F.lit(None).cast("array<string>").alias("_names"), F.lit(False).alias("_own"), "_cut")
        order = Order(keys=(stream,), by=(at, "_own"))
        rows, order = chunked(places.withColumn("_cut", F.lit(None).cast("long")).unionByName(cuts), order, chunk_width(segments, order))
        places = running(rows, order, {"_from": ("max", F.col("_cut"))}, inclusive=True).where("_own").select(*keys, "_names", F.coalesce("_from", F.lit(0).cast("long")).alias("_from"))
    else:
        places = places.select(*keys, "_names", F.lit(0).cast("long").alias("_from"))
    places = materialise(places, "ledger-places")
    firsts = places.groupBy(stream, "_names", "_from").agg(F.min(at).alias("_first"))
    classes = places.join(firsts.hint("merge"), [stream, "_names", "_from"]).select(*keys, "_first")

    own = [F.struct(F.lit(i).alias("level"), F.floor(F.col("_from") / FAN**i).alias("block")) for i in range(levels)]
    whole = F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("block"))
    firsts = firsts.withColumn("_who", F.explode("_names")).withColumn("_b", F.explode(F.array(whole, *own)))
    firsts = firsts.select(stream, F.col("_first").alias(at), F.col("_names").alias("_shown"), "_who", "_b")
    scope, void = F.col("scope"), F.array().cast("array<string>")
    who = (
        F.when(scope.isin("title", "temporary"), F.array(F.lit("all"))).when(scope == "scene", scenes(F.col("scene_ids")))
        .when((scope == "speaker") & F.col("speaker_id").isNotNull(), F.array(name("speaker", F.col("speaker_id"))))
        .when(scope == "relationship", F.array(name("relationship", F.col("speaker_id"), F.col("addressee_id")))).otherwise(void)
    )
    low, high = F.coalesce("_low", F.lit(0).cast("long")), F.coalesce("_high", F.lit(last).cast("long"))
    blocks = F.when(F.col("_low").isNull() & F.col("_high").isNull(), F.array(whole)).when(low <= high, _covering(low, high, levels))
    kinds = ("entry_type", "scope", "key", "speaker_id", "addressee_id")
    entries = entries.withColumns({"_g": F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in kinds]), "_of": F.array_distinct(who), "_sure": F.col("status") == "confirmed"})
    entries = entries.withColumn("_who", F.explode("_of")).withColumn("_b", F.explode(blocks))
    met_on = [stream, "_who", "_b", "_g"]
    entries = entries.select(*met_on, "entry_id", *kinds[:3], "value", "_sure", F.when(scope == "scene", F.col("_of")).alias("_of")).repartition(tasks, *met_on)
    # what a group of entries says at a place; whether a class's places disagree needs no pair of class and entry
    sure = F.when(F.col("_sure"), F.col("value"))
    met = firsts.join(entries.groupBy(*met_on).agg(F.min(sure).alias("_min"), F.max(sure).alias("_max")).hint("merge"), met_on[:3])
    group = Window.partitionBy(*keys, "_g")
    met = met.withColumn("_clash", F.coalesce(F.min("_min").over(group) != F.max("_max").over(group), F.lit(False))).drop("_min", "_max")
    hits = entries.join(met.repartition(tasks, *met_on).hint("merge"), met_on)
    # an entry and a class may share several scenes; the least of them counts
    hits = hits.where(F.col("_of").isNull() | (F.col("_who") == F.array_min(F.array_intersect("_of", "_shown"))))
    use = F.when(~F.col("_sure"), "unresolved").when(F.col("_clash"), "withheld_conflict").otherwise("applied")
    return materialise(hits.select(*keys, "entry_id", *kinds[:3], "value", use.alias("use")), "ledger-hits"), classes


def spread(rows: DataFrame, classes: DataFrame, keys: Sequence[str] = ("stream_id", "seq"), tile: int = TILE, made: int = MADE) -> DataFrame:
    """Each row of a class once for every member of it.

    ``rows``: keys of a class's first member, any values; read twice, so written before.  ``classes``: keys and ``_first``.
    Rows and members of a class meet in tiles of about ``tile`` by ``tile``, so that neither a large class nor one with many rows is one task;
    a task makes about ``made`` rows.
    """
    keys = list(keys)
    stream, at = keys
    values = [c for c in rows.columns if c not in keys]
    size = classes.groupBy(stream, F.col("_first").alias(at)).agg(F.count("*").alias("_m"))
    grid = rows.groupBy(*keys).agg(F.count("*").alias("_n")).join(size.hint("merge"), keys)
    grid = materialise(grid.select(*keys, (F.col("_n") * F.col("_m")).alias("_made"), F.ceil(F.col("_n") / tile).alias("_lots"), F.ceil(F.col("_m") / tile).alias("_cuts")), "grid")
    total = grid.agg(F.sum("_made")).first()[0] or 0
    tasks = max(1, -(-total // made), min(16, -(-total // 100_000)))
    by = [stream, "_first", "_lot", "_cut"]
    lists = classes.join(grid.withColumnRenamed(at, "_first").hint("merge"), [stream, "_first"]).withColumn("_cut", F.pmod(F.xxhash64(at), "_cuts"))
    lists = lists.groupBy(stream, "_first", "_cut", "_lots").agg(F.collect_list(at).alias("_members"))
    lists = lists.select(stream, "_first", "_cut", "_members", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1)).alias("_lot")).repartition(tasks, *by)
    rows = rows.join(grid.hint("merge"), keys).withColumn("_lot", F.pmod(F.xxhash64(*values), "_lots"))
    rows = rows.select(stream, F.col(at).alias("_first"), *values, "_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)).alias("_cut")).repartition(tasks, *by)
    return rows.join(lists.hint("merge"), by).select(stream, F.explode("_members").alias(at), *values)


def apply_ledger(
    ledger: DataFrame, segments: DataFrame, speakers: DataFrame, keys: Sequence[str] = ("stream_id", "seq"),
) -> DataFrame:
    """JOIN12: ledger entries that apply to each segment, by block range and scope.

    ``ledger``: stream_id, ``entry_id, entry_type, scope, key, value, status, scene_ids, speaker_id,
    addressee_id, start_block, end_block``.  ``segments``: keys, ``scene_ids``.  ``speakers``: keys,
    ``speaker_id, addressee_id, trusted``.  Confirmed entries whose matched set disagrees are
    withheld.

    Entries are matched and judged once for each class of segments (``ledger_classes``).
    """
    return spread(*ledger_classes(ledger, segments, speakers, keys), keys)


def evidence_bundle(
    segments: DataFrame, scenes: DataFrame, witnesses: DataFrame, previous: DataFrame, order: Order, k: int = 2,
) -> DataFrame:
    """JOIN13: segment with scene, witnesses (only if the scene is aligned), prior text and +-k neighbours.

    ``segments``: stream_id, ``seq, text, scene``.  ``scenes``: stream_id, ``scene, aligned, risks``.
    ``witnesses``: stream_id, ``scene, ref, text``.  ``previous``: stream_id, ``seq, text``.
    """
    near = context(segments, order, F.struct("seq", "text"), k, k)
    per = witnesses.groupBy("stream_id", "scene").agg(F.array_sort(F.collect_list(F.struct("ref", "text"))).alias("_w"))
    out = near.join(scenes, ["stream_id", "scene"], "left").join(per, ["stream_id", "scene"], "left")
    out = out.join(previous.select("stream_id", "seq", F.col("text").alias("previous_text")), ["stream_id", "seq"], "left")
    aligned = F.coalesce("aligned", F.lit(False))
    known, heard = F.col("aligned").isNotNull(), F.size(F.coalesce("_w", F.array())) > 0
    risks = F.array_compact(
        F.array(
            F.when(F.trim("text") == "", "missing-source"), F.when(known & ~aligned, "low-timeline-confidence"),
            F.when(known & ~aligned & heard, "audio-evidence-withheld"), F.when(known & ~heard, "missing-witness"),
        )
    )
    return out.withColumns(
        {
            "risk_codes": F.array_sort(F.array_union(F.coalesce("risks", F.array().cast("array<string>")), risks)),
            "witnesses": F.when(aligned, F.coalesce("_w", F.array())).otherwise(F.array()),
        }
    ).drop("risks", "_w")


def claim_gate(rows: DataFrame, keys: Sequence[str] = ("stream_id", "seq"), hold: str = "…") -> DataFrame:
    """AGG35: keep the primary text, the conservative one or none, by what each claims.

    ``rows``: keys, ``text, fallback_text, claims, fallback_claims`` (slot arrays), the arbitration
    columns ``state, rendered, provenance, fully_agreed, minimal_available`` and ``source_quality,
    dual_ok``.
    """
    damaged = F.col("source_quality").isin("suspect", "unusable") & ~F.col("dual_ok") & (F.col("state") != "vocalization")
    state = F.when(damaged, F.when(F.col("minimal_available"), "minimal_speech_act").otherwise("abstained")).otherwise(F.col("state"))
    rows = rows.withColumns({"_state": state, "_damaged": damaged})
    over = lambda c: (F.size(c) == 0) | (F.size(F.array_except(c, F.col("rendered"))) > 0)
    proven = F.forall("fallback_claims", lambda s: F.coalesce(F.col("provenance")[s].isin("dual_agreement", "dual_compatible"), F.lit(False)))
    tier = (
        F.when((F.size("fallback_claims") == 0) | ~proven, "abstained").when(F.col("_state") == "minimal_speech_act", "minimal_speech_act")
        .when(F.col("_state") == "accepted_consensus", F.when(F.col("fully_agreed"), "accepted_consensus").otherwise("accepted_partial"))
        .when(F.col("_state").isin("accepted_partial", "recovered_context"), "accepted_partial").otherwise("abstained")
    )
    rows = rows.withColumns({"_tier": tier, "_pover": over(F.col("claims")) & (F.col("_state") != "abstained")})
    fallback_ok = ~over(F.col("fallback_claims")) & (F.col("_tier") != "abstained") & ~F.coalesce(F.trim("fallback_text"), F.lit("")).isin("", hold)
    rows = rows.withColumn("_fok", fallback_ok)
    wants_fallback = (F.col("_state") == "minimal_speech_act") | F.col("_pover")
    final = (
        F.when(F.col("_state") == "abstained", "abstained").when(wants_fallback & F.col("_fok"), F.when(F.col("_pover"), F.col("_tier")).otherwise(F.col("_state")))
        .when(wants_fallback, "abstained").when(F.coalesce(F.trim("text"), F.lit("")) == "", "abstained").otherwise(F.col("_state"))
    )
    rows = rows.withColumn("final_state", final)
    used = F.when(F.col("final_state") == "abstained", "none").when(wants_fallback, "fallback").otherwise("primary")
    codes = F.array_compact(
        F.array(
            F.when(F.col("_damaged"), "damaged-source-without-two-family-evidence"), F.when(F.size("claims") == 0, "missing-claimed-slots"),
            F.when(F.size(F.array_except("claims", "rendered")) > 0, "claims-omitted-slot"),
        )
    )
    return rows.withColumns(
        {
            "used": used, "reason_codes": codes,
            "final_text": F.when(used == "primary", F.col("text")).when(used == "fallback", F.col("fallback_text")).otherwise(F.lit(hold)),
            "final_slots": F.when(used == "primary", F.array_sort("claims")).when(used == "fallback", F.array_sort("fallback_claims")).otherwise(F.array()),
            "fallback_safe": F.col("_fok"),
        }
    ).drop("_state", "_damaged", "_tier", "_pover", "_fok")


def apply_reviews(rows: DataFrame, reviews: DataFrame, keys: Sequence[str] = ("stream_id", "seq"), hold: str = "…") -> DataFrame:
    """AGG36: keep a row only on a clean accept; otherwise its safe fallback; otherwise abstain.

    ``reviews``: keys, ``verdict, findings`` (array of struct with ``disposition``),
    ``unsupported_additions`` (array), ``fallback_blocking``.
    """
    r = reviews.select(
        *keys, F.col("verdict").alias("_verdict"), F.col("findings").alias("_found"), F.col("unsupported_additions").alias("_added"),
        F.col("fallback_blocking").alias("_fb"),
    )
    out = rows.join(r, list(keys), "left")
    blocked = F.coalesce(F.exists("_found", lambda f: f["disposition"] == "blocking"), F.lit(False))
    clean = F.coalesce(F.col("_verdict") == "accept", F.lit(False)) & ~blocked & (F.size(F.coalesce("_added", F.array())) == 0)
    safe = (
        F.col("fallback_safe") & ~F.coalesce(F.trim("fallback_text"), F.lit("")).isin("", hold) & (F.size("fallback_claims") > 0)
        & ~F.coalesce("_fb", F.lit(False))
    )
    used = F.when(clean, "kept").when(safe, "fallback").otherwise("abstained")
    return out.withColumns(
        {"outcome": used, "reviewed_text": F.when(used == "kept", F.col("final_text")).when(used == "fallback", F.col("fallback_text")).otherwise(F.lit(hold))}
    ).drop("_verdict", "_found", "_added", "_fb")
