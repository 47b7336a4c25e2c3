"""Per-stream quality rollups, risk scores, timeline and corpus comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded
from tidemark.operators.ordered import Order, chunked, neighbour, position, running
from tidemark.operators.sequences import runs, with_totals


def times(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def content_prints(rows: DataFrame, order: Order, block: int = 1024) -> DataFrame:
    """Per stream the number of its characters, white space left out, and a fingerprint of them, however they are cut into rows.

    Texts are cut where the stream's characters reach a multiple of ``block``; the pieces of a block are put together
    and hashed, and the hashes of a stream's blocks are combined.  So every task holds a block.
    """
    keys = list(order.keys)
    solid = rows.withColumn("_solid", tx.compact(F.col("text")))
    solid = running(solid, order, {"_at": ("sum", F.length("_solid").cast("long"))}).where("_solid <> ''")
    spots = F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.length("_solid") - 1) / block))
    parts = solid.select(*keys, "_solid", "_at", F.explode(spots).alias("_b"))
    begin = F.greatest(F.col("_b") * block - F.col("_at"), F.lit(0))
    piece = F.substring("_solid", (begin + 1).cast("int"), (F.least((F.col("_b") + 1) * block - F.col("_at"), F.length("_solid").cast("long")) - begin).cast("int"))
    whole = parts.groupBy(*keys, "_b").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_at", piece.alias("p"))))["p"], "").alias("_text"))
    return whole.groupBy(*keys).agg(F.sum(F.length("_text")).alias("_n"), F.bit_xor(F.xxhash64("_b", "_text")).alias("_h"))


def qc_rollup(
    cues: DataFrame, order: Order, durations: DataFrame, warnings: Sequence[str] = (), max_width: float = 26.0,
    short_ms: int = 800, long_ms: int = 7000, tolerance_ms: int = 1, source: DataFrame | None = None,
) -> DataFrame:
    """AGG1: one row of cue quality per stream, a gate and its (code, count) reasons.

    ``cues`` may carry a ``warnings`` array.  ``source`` rows check that the characters other than white space are
    unchanged and in the same order, however they are cut into cues.
    """
    keys = list(order.keys)
    mine = content_prints(cues, order) if source is not None else None
    cues = position(running(cues, order, {"_pe": ("max", F.col("end_ms"))}), order, "_pos")
    span = F.col("end_ms") - F.col("start_ms")
    n_lines = F.size(tx.lines(F.col("text")))
    wide = F.exists(tx.lines(F.col("text")), lambda x: tx.display_width(x) > max_width)
    has_warnings = "warnings" in cues.columns
    out = cues.groupBy(*keys).agg(
        F.count("*").alias("cues"),
        F.avg(span).alias("avg_ms"), F.min(span).alias("min_ms"), F.max(span).alias("max_ms"),
        times(span < short_ms).alias("short_cues"), times(span > long_ms).alias("long_cues"),
        times(n_lines == 1).alias("one_line"), times(n_lines == 2).alias("two_lines"), times(wide).alias("too_wide"),
        times(F.col("start_ms") < F.col("_pe") - tolerance_ms).alias("overlap_rows"), times(F.col("seq") != F.col("_pos")).alias("_breaks"),
        times(span <= 0).alias("reversals"), times(F.trim("text") == "").alias("empty_cues"),
        times(tx.has_runaway(F.col("text"))).alias("runaway"),
        *[times(F.array_contains("warnings", w)).alias(f"warn_{w}") for w in warnings if has_warnings],
    )
    out = out.join(durations, keys, "left")
    out = out.withColumn("cues_per_minute", F.when(F.col("duration_ms") > 0, F.col("cues") * 60_000.0 / F.col("duration_ms")).otherwise(0.0))
    mismatch = F.lit(0)
    if source is not None:
        theirs = content_prints(source, order).select(*keys, F.col("_n").alias("_rn"), F.col("_h").alias("_rh"))
        out = out.join(mine, keys, "left").join(theirs, keys, "left")
        out = out.withColumn("content_preserved", F.col("_n").eqNullSafe(F.col("_rn")) & F.col("_h").eqNullSafe(F.col("_rh")))
        mismatch = (~F.col("content_preserved")).cast("int")
    checks = [("runaway", F.col("runaway")), *[(w, F.col(f"warn_{w}")) for w in warnings if has_warnings], ("content_mismatch", mismatch)]
    reasons = F.array_compact(F.array(*[F.when(c > 0, F.struct(F.lit(n).alias("code"), c.cast("long").alias("count"))) for n, c in checks]))
    broken = F.col("overlap_rows") + F.col("reversals") + F.col("empty_cues") + F.col("_breaks")
    gate = F.when(broken > 0, "failed").when(F.size(reasons) > 0, "review_required").otherwise("passed")
    return out.withColumns({"reasons": reasons, "gate": gate}).drop("_n", "_h", "_rn", "_rh", "_breaks")


def word_alignment(segments: DataFrame, keys: Sequence[str] = ("stream_id",), tolerance_ms: int = 50, long_ms: int = 7000) -> DataFrame:
    """AGG2: anomalies of nested words; ``words`` is an array of (text, start_ms, end_ms).

    Everything about a segment is in its row, so the running maximum of word starts is an array
    fold and only the per-stream sums shuffle.
    """
    usable = F.filter("words", lambda w: w["start_ms"].isNotNull() & w["end_ms"].isNotNull())
    starts = F.col("_ok.start_ms")
    back = F.aggregate(
        starts,
        F.struct(F.lit(None).cast("long").alias("top"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["top"], s).alias("top"), (acc["n"] + F.when(s < acc["top"], 1).otherwise(0)).alias("n")),
        lambda acc: acc["n"],
    )

    def many(pred) -> Column:
        return F.size(F.filter("_ok", pred))

    rows = segments.withColumn("_ok", usable)
    rows = rows.select(
        *keys, F.size("words").alias("total_words"), (F.size("words") - F.size("_ok")).alias("non_finite_words"),
        many(lambda w: w["end_ms"] <= w["start_ms"]).alias("non_positive_words"),
        many(lambda w: w["end_ms"] - w["start_ms"] > long_ms).alias("long_words"),
        many(lambda w: (w["start_ms"] < F.col("start_ms") - tolerance_ms) | (w["end_ms"] > F.col("end_ms") + tolerance_ms)).alias("outside_words"),
        back.alias("non_monotonic_words"),
    )
    odd = ["non_finite_words", "non_positive_words", "long_words", "outside_words", "non_monotonic_words"]
    affected = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in odd])
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in ["total_words", *odd]], times(affected).alias("review_segments"))


def warning_counts(cues: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG3: a warning counts once per set of source segments however many cues carry it."""
    lineage = F.when(F.size("source_ids") > 0, F.array_join(F.array_sort(F.array_distinct("source_ids")).cast("array<string>"), ",")).otherwise(
        F.concat(F.lit("cue:"), F.col("seq").cast("string"))
    )
    rows = cues.select(*keys, lineage.alias("_from"), F.explode("warnings").alias("warning")).dropDuplicates([*keys, "_from", "warning"])
    return rows.groupBy(*keys, "warning").agg(F.count("*").alias("n"))


def source_quality(df: DataFrame, order: Order, broken: str, boilerplate: str, short_repeat: Column | None = None,
                   evidence: DataFrame | None = None) -> DataFrame:
    """AGG4: trusted / suspect / unusable per segment with reasons.

    ``evidence`` (optional): keys, ``seq``, ``source_similarity``, ``family_agreement``.
    """
    keys = list(order.keys)
    rows = runs(df, order, tx.word_key(F.col("text")))
    rows = with_totals(rows, order, [*keys, "run_key"], {"reuse": F.count("*")})
    rows = with_totals(rows, order, keys, {"_n": F.count("*"), "_end": F.max("end_ms")})
    if evidence is not None:
        rows = rows.join(evidence.select(*keys, "seq", "source_similarity", "family_agreement"), [*keys, "seq"], "left")
        conflict = (F.col("family_agreement") >= 0.75) & (F.col("source_similarity") < 0.35)
    else:
        conflict = F.lit(False)
    legit = F.coalesce(short_repeat, F.lit(False)) if short_repeat is not None else F.lit(False)
    seen = F.when(F.col("run_key") == "", 0).otherwise(F.col("reuse"))
    text = F.col("text")
    long_run, hard_run = ~legit & (F.col("run_length") >= 5), ~legit & (F.col("run_length") >= 8)
    often = ~legit & (seen >= F.greatest(F.lit(8), F.floor(F.col("_n") * 0.05)))
    too_often = ~legit & (seen >= F.greatest(F.lit(20), F.floor(F.col("_n") * 0.15)))
    checks = [
        ("empty-source", F.trim(text) == "", F.lit(True)),
        ("broken-characters", text.rlike(broken), F.lit(True)),
        ("early-boilerplate", text.rlike(boilerplate) & (F.col("start_ms") * 100 < F.col("_end") * 97), F.lit(True)),
        ("long-consecutive-repeat", long_run, hard_run),
        ("high-global-reuse", often, too_often),
        ("dual-witness-conflict", F.coalesce(conflict, F.lit(False)), F.lit(True)),
    ]
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in checks])))
    hard = reduce(lambda a, b: a | b, [c & h for _, c, h in checks])
    status = F.when(hard, "unusable").when(F.size(reasons) > 0, "suspect").otherwise("trusted")
    return rows.withColumns({"reasons": reasons, "quality": status, "reuse": seen}).drop("_n", "_end")


def witness_similarity(segments: DataFrame, transcripts: DataFrame, keys: Sequence[str] = ("stream_id", "seq"), similar: str = "bigram") -> DataFrame:
    """AGG4 (evidence): how near each segment's families come to its text, and to each other.

    ``transcripts``: keys, ``family, part, text, block_aligned``.  A family's parts are put together in order; the best family counts.
    Segments with a transcript that is not aligned to them have no similarity.  The result feeds ``source_quality``.
    """
    keys = list(keys)
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    said = transcripts.groupBy(*keys, "family").agg(F.array_join(parts["text"], " ").alias("_said"), F.bool_and(F.coalesce("block_aligned", F.lit(False))).alias("_fits"))
    # a segment has as many entries as there are families
    per = said.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("family", tx.word_key(F.col("_said")).alias("k")))).alias("_f"), F.bool_and("_fits").alias("_fits")).where("_fits")
    rows = segments.select(*keys, tx.word_key(F.col("text")).alias("_k")).join(per, keys)
    grid = F.flatten(F.transform("_f", lambda a, i: F.transform(F.slice("_f", i + 2, F.size("_f")), lambda b: F.struct(a["k"].alias("l"), b["k"].alias("r")))))
    asked = F.concat(F.transform("_f", lambda f: F.struct(F.lit(True).alias("own"), F.col("_k").alias("l"), f["k"].alias("r"))), F.transform(grid, lambda p: F.struct(F.lit(False).alias("own"), p["l"].alias("l"), p["r"].alias("r"))))
    pairs = rows.select(*keys, F.explode(asked).alias("p")).select(*keys, "p.*")
    blank = (F.col("l") == "") | (F.col("r") == "")
    like = F.when(blank, (F.col("l") == F.col("r")).cast("double")).otherwise(tx.similarity(similar, F.col("l"), F.col("r")))
    best = pairs.withColumn("_s", like).groupBy(*keys).agg(F.max(F.when(F.col("own"), F.col("_s"))).alias("s"), F.max(F.when(~F.col("own"), F.col("_s"))).alias("a"))
    return best.select(*keys, rounded("s", 4).alias("source_similarity"), rounded("a", 4).alias("family_agreement"))


def source_quality_report(rows: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG4 (report): status counts, lexical diversity and longest run per stream."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        *[times(F.col("quality") == q).alias(q) for q in ("trusted", "suspect", "unusable")],
        (F.count_distinct(F.when(F.col("run_key") != "", F.col("run_key"))) / F.count("*")).alias("lexical_diversity"),
        F.max("run_length").cast("long").alias("longest_run"),
    )


def stream_risk(df: DataFrame, order: Order, forbidden: str, placeholder: str, boilerplate: Sequence[str], max_line: int = 32,
                micro_ms: int = 250, long_ms: int = 30_000, top: int = 20, often: int = 4) -> DataFrame:
    """AGG23: composite risk score per stream, worst streams first when sorted by ``risk_score``."""
    keys = list(order.keys)
    text, key = F.col("text"), tx.squeeze(F.col("text"))
    semantic = tx.word_key(text) != ""
    rows = neighbour(df, order, {"_p": F.struct(key.alias("k"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))})
    span = F.col("end_ms") - F.col("start_ms")
    phrase = reduce(lambda a, b: a + b, [(F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p) for p in [placeholder]])
    boiler = reduce(lambda a, b: a + b, [(F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p) for p in boilerplate])
    flags = rows.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.sum(F.regexp_count(text, F.lit(forbidden))).cast("long").alias("forbidden_chars"),
        F.sum(phrase).cast("long").alias("placeholders"), F.sum(boiler).cast("long").alias("boilerplate"),
        times(span <= 0).alias("invalid"), times(F.col("start_ms") < F.col("_p.s")).alias("out_of_order"),
        times(F.col("start_ms") < F.col("_p.e")).alias("overlap_rows"), times((span < micro_ms) & semantic).alias("micro"),
        times(semantic & (F.col("_p.k") == key)).alias("adjacent_duplicates"), times((span > long_ms) & semantic).alias("long_rows"),
        times(F.array_max(F.transform(tx.lines(text), lambda x: F.length(x))) > max_line).alias("overlong_lines"),
        times(F.size(tx.lines(text)) > 2).alias("too_many_lines"),
    )
    counts = df.where(semantic).groupBy(*keys, key.alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") >= often)
    w = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), "_k")
    excess = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).groupBy(*keys).agg(F.sum(F.col("_n") - 3).alias("repeat_excess"))
    out = flags.join(excess, keys, "left").withColumn("repeat_excess", F.coalesce("repeat_excess", F.lit(0)).cast("long"))
    weights = {
        "forbidden_chars": 20, "placeholders": 20, "boilerplate": 12, "invalid": 5, "out_of_order": 8, "overlap_rows": 2, "micro": 3,
        "adjacent_duplicates": 3, "long_rows": 2, "repeat_excess": 1, "overlong_lines": 1, "too_many_lines": 2,
    }
    return out.withColumn("risk_score", reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()]))


def offset_consistency(pairs: DataFrame, keys: Sequence[str] = ("stream_id",), tolerance_ms: int = 1500) -> DataFrame:
    """AGG24: offset of each scene against the stream's upper median; coverage and status.

    ``pairs``: keys, ``scene``, ``offset_ms`` (null when the scene has no anchor).  The upper median
    is found from counted offsets, never from one list of all offsets.
    """
    keys = list(keys)
    counted = pairs.where("offset_ms is not null").groupBy(*keys, "offset_ms").agg(F.count("*").alias("_c"))
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    counted, order = chunked(counted, Order(tuple(keys), ("offset_ms",)), 60_000)
    ranked = running(counted, order, {"_before": ("sum", F.col("_c"))}).join(sizes, keys)
    half = F.floor(F.col("_n") / 2)
    median = ranked.where((F.col("_before") <= half) & (half < F.col("_before") + F.col("_c"))).select(*keys, F.col("offset_ms").alias("median_ms"))
    near = pairs.join(median, keys, "left").withColumn("_near", F.abs(F.col("offset_ms") - F.col("median_ms")) <= tolerance_ms)
    out = near.groupBy(*keys).agg(
        F.count("*").alias("scenes"), F.count("offset_ms").alias("anchored"), times(F.col("_near")).alias("consistent"), F.max("median_ms").alias("median_ms")
    )
    status = F.when(F.col("anchored") == 0, "no_anchor").when(F.col("consistent") == F.col("anchored"), "consistent").otherwise("inconsistent")
    return out.withColumns({"coverage": F.col("anchored") / F.col("scenes"), "status": status})


def row_coverage(scenes: DataFrame, keys: Sequence[str] = ("stream_id",), tolerance_ms: int = 1500, similar_at: float = 0.20) -> DataFrame:
    """AGG24 (rows): which share of a stream's rows lies in scenes that fit its timeline.

    ``scenes``: keys, ``scene, offset_ms, n_rows, profiles, best_similarity``; a scene without ``offset_ms`` is no candidate.  A scene fits if
    its offset is near the stream's upper median and somebody heard speech in it; how alike the texts are is told apart.
    """
    keys = list(keys)
    median = offset_consistency(scenes, keys, tolerance_ms).select(*keys, "median_ms")
    rows = scenes.join(median, keys)
    candidate = F.col("offset_ms").isNotNull()
    heard = candidate & (F.col("profiles") > 0)
    fits = heard & (F.abs(F.col("offset_ms") - F.col("median_ms")) <= tolerance_ms)
    out = rows.groupBy(*keys).agg(
        F.sum(F.when(fits, F.col("n_rows")).otherwise(0)).cast("long").alias("mapped_rows"), F.sum("n_rows").cast("long").alias("total_rows"), times(candidate).alias("candidates"),
        times(heard & (F.col("best_similarity") >= similar_at)).alias("compatible_scenes"), F.avg(F.when(candidate, F.coalesce("best_similarity", F.lit(0.0)))).alias("_mean"), F.max("median_ms").alias("median_ms"),
    )
    status = F.when(F.col("candidates") == 0, "text-only").when(F.col("mapped_rows") > 0, "machine-aligned").otherwise("machine-aligned-low-confidence")
    return out.withColumns(
        {"coverage": F.col("mapped_rows") / F.greatest(F.col("total_rows"), F.lit(1)), "status": status, "mean_similarity": F.coalesce("_mean", F.lit(0.0))}
    ).drop("_mean")


def anchor_bands(anchors: DataFrame, durations: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG24 (bands): anchors in the early, middle and late third of each stream."""
    place = F.col("at_ms") / F.col("duration_ms")
    rows = anchors.join(durations, list(keys))
    return rows.groupBy(*keys).agg(
        times(place <= 0.34).alias("early"), times((place > 0.34) & (place < 0.67)).alias("middle"), times(place >= 0.67).alias("late")
    ).withColumn("all_bands", (F.col("early") > 0) & (F.col("middle") > 0) & (F.col("late") > 0))


def timeline_verdict(anchors: DataFrame, media: DataFrame, keys: Sequence[str] = ("stream_id",), tolerance_ms: int = 500) -> DataFrame:
    """AGG25: exact, constant offset, drift, unresolved or media too short.

    ``anchors``: keys, ``text_ms, media_ms``; ``media``: keys, ``media_len_ms, text_len_ms``.
    """
    off = F.col("media_ms") - F.col("text_ms")
    a = anchors.groupBy(*keys).agg(F.count("*").alias("anchors"), F.min(off).alias("low"), F.max(off).alias("high"), F.max(F.abs(off)).alias("worst"))
    out = media.join(a, list(keys), "left").withColumn("anchors", F.coalesce("anchors", F.lit(0)))
    tight = F.col("high") - F.col("low") <= tolerance_ms
    verdict = (
        F.when(F.col("media_len_ms") < F.col("text_len_ms"), "media_too_short").when(F.col("anchors") < 3, "unresolved")
        .when(tight & (F.col("worst") <= tolerance_ms), "exact").when(tight, "constant_offset").otherwise("drift")
    )
    return out.withColumns({"verdict": verdict, "needs_approval": verdict == "constant_offset"})


def anchor_rows(df: DataFrame, order: Order, percents: Sequence[int] = (10, 50, 90)) -> DataFrame:
    """AGG25 (anchors): the rows at given percents of each stream."""
    from tidemark.operators.ordered import position

    rows = position(df, order, "_pos")
    sizes = df.groupBy(*order.keys).agg(F.count("*").alias("_n"))
    picks = F.array(*[F.least(F.col("_n") - 1, F.floor(F.col("_n") * p / 100)) for p in percents])
    return rows.join(sizes, list(order.keys)).where(F.array_contains(picks, F.col("_pos") - 1)).drop("_pos", "_n")


def corpus_comparison(left: DataFrame, right: DataFrame, order: Order) -> DataFrame:
    """AGG26: character-pair overlap of two concatenated corpora, lengths and shown time.

    Pairs across row borders come from joining each text with the next row's first character,
    so no stream is ever concatenated in one place.
    """
    keys = list(order.keys)

    def pairs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = df.withColumn("_t", tx.compact(F.col("text")))
        totals = rows.groupBy(*keys).agg(F.sum(F.length("_t")).alias("chars"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("shown_ms"))
        rows = neighbour(rows.where("_t <> ''"), order, {"_nx": F.substring("_t", 1, 1)}, following=True)
        rows = rows.withColumn("_j", F.concat("_t", F.coalesce("_nx", F.lit("")))).where(F.length("_j") >= 2)
        return rows.select(*keys, F.explode(tx.bigrams(F.col("_j"))).alias("g")).distinct(), totals

    (lg, lt), (rg, rt) = pairs(left), pairs(right)
    both = lg.withColumn("_l", F.lit(1)).join(rg.withColumn("_r", F.lit(1)), [*keys, "g"], "full_outer")
    shared = both.groupBy(*keys).agg(
        times(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("common"), F.count("_l").alias("left_pairs"), F.count("_r").alias("right_pairs"), F.count("*").alias("all_pairs")
    )
    lt = lt.withColumnsRenamed({"chars": "left_chars", "shown_ms": "left_shown_ms"})
    rt = rt.withColumnsRenamed({"chars": "right_chars", "shown_ms": "right_shown_ms"})
    out = shared.join(lt, keys, "left").join(rt, keys, "left")
    return out.withColumns(
        {
            "jaccard": F.try_divide(F.col("common").cast("double"), F.col("all_pairs")),
            "coverage": F.try_divide(F.col("common").cast("double"), F.col("right_pairs")),
            "precision": F.try_divide(F.col("common").cast("double"), F.col("left_pairs")),
            "length_ratio": F.try_divide(F.col("left_chars").cast("double"), F.col("right_chars")),
        }
    )


def readiness(files: DataFrame, roles: Sequence[str], keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """AGG32: one boolean per needed role and the list of missing ones."""
    out = files.groupBy(*keys).agg(*[F.coalesce(F.bool_or(F.col("role") == r), F.lit(False)).alias(f"has_{r}") for r in roles])
    missing = F.array_compact(F.array(*[F.when(~F.col(f"has_{r}"), F.lit(r)) for r in roles]))
    return out.withColumns({"missing": missing, "ready": F.size(missing) == 0})
