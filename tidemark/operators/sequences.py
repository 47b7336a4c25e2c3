"""Ordered-sequence operators: runs, repeats, sessions, window plans and retiming.

Everything that only looks at earlier or later rows is written with the running values
of ``ordered``.  Rules where each decision depends on the decision before it go through
``fold_rows``, which emits a start flag per row and never a counter, so blocks of a very
long stream settle independently; numbers come afterwards from a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.operators.intervals import interval_pairs
from tidemark.operators.ordered import (
    TIME, Order, chunked, fold_rows, islands, neighbour, next_greater, overlap_islands, position, running,
)
from tidemark.session import materialise

LONG, BOOL, STR = T.LongType(), T.BooleanType(), T.StringType()


def outputs(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# --- runs and repeats ---------------------------------------------------------------------


def with_totals(df: DataFrame, order: Order, group: list[str], totals: dict[str, Column]) -> DataFrame:
    """Totals of each group of a stream's rows, beside its rows.

    An unchunked order has a stream's rows in one task already, so they are windows there and the rows don't move again; a chunked one
    joins a table of totals.
    """
    if order.chunk is None:
        return df.withColumns({name: total.over(Window.partitionBy(*group)) for name, total in totals.items()})
    return df.join(df.groupBy(*group).agg(*[total.alias(name) for name, total in totals.items()]), group)


def runs(df: DataFrame, order: Order, key: Column) -> DataFrame:
    """WIN1: length and first row of the run of equal non-blank keys each row belongs to."""
    df = df.withColumn("_key", key)
    df = neighbour(df, order, {"_pkey": F.col("_key")})
    fresh = F.col("_pkey").isNull() | (F.col("_pkey") != F.col("_key")) | (F.col("_key") == "")
    df = islands(df, order, fresh, "_run")
    out = with_totals(df, order, [*order.keys, "_run"], {"run_length": F.count("*"), "run_start": F.min("seq")})
    blank = F.col("_key") == ""
    return out.withColumns(
        {
            "run_length": F.when(blank, F.lit(0)).otherwise(F.col("run_length")),
            "run_start": F.when(~blank, F.col("run_start")),
        }
    ).drop("_pkey", "_run").withColumnRenamed("_key", "run_key")


def order_flags(df: DataFrame, order: Order, key: Column) -> DataFrame:
    """WIN2: adjacent duplicate, out-of-order and overlap flags against the previous row."""
    df = neighbour(df.withColumn("_key", key), order, {"_p": F.struct(F.col("_key").alias("k"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))})
    return df.withColumns(
        {
            "adjacent_duplicate": F.coalesce((F.col("_key") != "") & (F.col("_p.k") == F.col("_key")), F.lit(False)),
            "out_of_order": F.coalesce(F.col("start_ms") < F.col("_p.s"), F.lit(False)),
            "overlaps_previous": F.coalesce(F.col("start_ms") < F.col("_p.e"), F.lit(False)),
        }
    ).drop("_key", "_p")


def merge_equal_text(df: DataFrame, order: Order, max_gap_ms: int = 120) -> DataFrame:
    """WIN13: neighbours with the same text and a small gap become one row (chains collapse)."""
    same = tx.squeeze(F.col("text"))
    df = neighbour(df, order, {"_ptext": same})
    df = islands(df, order, F.col("_ptext").isNull() | (F.col("_ptext") != same), "_same")
    inner = Order((*order.keys, "_same"), order.by, order.chunk)
    df = overlap_islands(df, inner, max_gap_ms, "_isl")
    by = F.struct(*order.by)
    return df.groupBy(*order.keys, "_same", "_isl").agg(
        F.min_by("seq", by).alias("seq"), F.min_by("start_ms", by).alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.min_by("text", by).alias("text"), F.count("*").alias("merged_rows"),
    ).drop("_same", "_isl")


def collapse_repeats(df: DataFrame, order: Order, eligible: Column, max_gap_ms: int = 150, longest_ms: int = 7000) -> DataFrame:
    """WIN21: neighbouring eligible cues of one source with one text become one bounded cue.

    Needs ``source_key``; the end is the last member's, at most ``longest_ms`` after the start.
    """
    df = df.withColumn("_ok", eligible)
    near = F.struct(F.col("source_key").alias("k"), F.col("text").alias("t"), F.col("end_ms").alias("e"), F.col("_ok").alias("ok"))
    df = neighbour(df, order, {"_p": near})
    joins = (
        F.col("_ok") & F.col("_p.ok") & F.col("source_key").eqNullSafe(F.col("_p.k"))
        & (F.col("text") == F.col("_p.t")) & (F.col("start_ms") <= F.col("_p.e") + max_gap_ms)
    )
    df = islands(df, order, ~F.coalesce(joins, F.lit(False)), "_isl")
    by = F.struct(*order.by)
    grouped = df.groupBy(*order.keys, "_isl").agg(
        F.min_by("seq", by).alias("seq"), F.min_by("start_ms", by).alias("start_ms"), F.max_by("end_ms", by).alias("_last"),
        F.min_by("text", by).alias("text"), F.count("*").alias("members"),
    )
    end = F.when(F.col("members") > 1, F.least(F.col("_last"), F.col("start_ms") + longest_ms)).otherwise(F.col("_last"))
    return grouped.withColumn("end_ms", end).drop("_isl", "_last")


def keep_first(
    df: DataFrame, order: Order, similar: str = "sequence", at_least: float = 0.8, min_overlap: float = 0.5,
    floor_ms: int = 100, lookback: int | None = 6, max_apart_ms: int | None = 3000, max_rows: int = 1_000_000,
    same: tuple[str, ...] = ("family",), start_within_ms: int | None = None, above: bool = False, width_ms: int = 60_000,
) -> DataFrame:
    """WIN12: drop rows nearly repeating an already kept row with the same ``same`` columns.

    Two rows may repeat each other if they overlap by ``min_overlap`` of the shorter (or, with ``start_within_ms``, start that near to
    each other) and are alike by ``at_least`` (``above``: by more).  A row looks at the last ``lookback`` kept rows of the stream, newest
    first, and stops at one that ended more than ``max_apart_ms`` before; ``lookback=None`` looks at every kept row.  Two blank rows
    repeat each other where ``lookback`` bounds the view, never where all kept rows count; where starts are compared, blank
    rows are left out beforehand.

    Candidates come from a bucketed self range join (``width_ms`` near the usual length of a row), which also compares the texts.  Rows that no
    pair spans need no decision.  The others form islands, position ranges that no pair leaves; the greedy rule runs
    over positions and pairs of an island, no texts.
    """
    keys = list(order.keys)
    blank = F.trim(F.regexp_replace("text", tx.WS, " ")) == ""
    rows = df.where(~blank) if start_within_ms is not None else df
    rows = materialise(position(rows, order, "_at"), "keep-rows")
    slim = rows.select(*keys, *[c for c in same if c not in keys], "start_ms", "end_ms", "_at", "text", blank.alias("blank"), F.col("end_ms").alias("until"))
    if start_within_ms is not None:
        slim = slim.withColumn("end_ms", F.col("start_ms") + start_within_ms)
    found = interval_pairs(slim, slim, width_ms, tuple(dict.fromkeys((*keys, *same))), F.col("r__at") < F.col("_at"))
    if start_within_ms is None:
        shorter = F.least(F.col("until") - F.col("start_ms"), F.col("r_until") - F.col("r_start_ms"))
        found = found.where(F.col("overlap_ms") >= min_overlap * F.greatest(F.lit(floor_ms), shorter))
    both = F.col("blank") & F.col("r_blank")
    if lookback is None:
        found, both = found.where(~F.col("blank") & ~F.col("r_blank")), F.lit(False)
    else:
        found = found.where(F.col("blank") == F.col("r_blank"))
    alike = F.when(both, F.lit(1.0)).otherwise(tx.similarity(similar, F.col("text"), F.col("r_text")))
    pairs = materialise(found.where(alike > at_least if above else alike >= at_least).select(*keys, "_at", F.col("r__at").alias("_i")), "keep-pairs")

    reach = pairs.groupBy(*keys, F.col("_i").alias("_at")).agg(F.max("_at").alias("_reach"))
    spans = rows.select(*order.part, *[c for c in order.by if c not in order.part], "_at", *[c for c in ("start_ms", "end_ms") if c not in order.by]).join(reach, [*keys, "_at"], "left")
    spans = running(spans, order, {"_far": ("max", F.col("_reach"))})
    spans = islands(spans, order, F.col("_far").isNull() | (F.col("_far") < F.col("_at")), "_isl")
    members = spans.where(F.col("_reach").isNotNull() | (F.col("_far") >= F.col("_at")))
    members = materialise(members.select(*keys, "_isl", "_at", "start_ms", "end_ms", F.coalesce("_reach", "_at").alias("_reach")), "keep-islands")
    asked = pairs.join(members, [*keys, "_at"]).withColumn("_kind", F.lit(0))
    told = members.withColumns({"_i": F.lit(None).cast("long"), "_kind": F.lit(1)})

    def step(state, pos, i, start, end, far):
        kept, dup = state or ([], False)
        if i is None:
            kept = kept if dup else [*kept, [pos, end, far]]
            kept = [k for k in kept if k[2] > pos] if lookback is None else kept[-lookback:]
            return [kept, False], (not dup,)
        for k_pos, k_end, _ in reversed(kept if lookback is None else kept[-lookback:]):
            if k_pos < i or (max_apart_ms is not None and start - k_end > max_apart_ms):
                break
            if k_pos == i:
                return [kept, True], (None,)
        return [kept, dup], (None,)

    line = Order((*keys, "_isl"), ("_at", "_kind", "_i"))
    judged = fold_rows(asked.select(*told.columns).unionByName(told), line, ["_at", "_i", "start_ms", "end_ms", "_reach"], step, outputs(_keep=BOOL), max_rows, count_from=members)
    gone = judged.where("not _keep").select(*keys, "_at")
    return rows.join(gone, [*keys, "_at"], "left_anti").select(*df.columns)


# --- sessions ------------------------------------------------------------------------------


def padded_sessions(
    df: DataFrame, order: Order, pad_ms: int = 2500, gap_ms: int = 1500, span_ms: int = 45_000, max_rows: int = 1_000_000
) -> DataFrame:
    """WIN5: padded rows join a scene unless the gap or the total span gets too large.

    ``band`` is a small number, the lowest of a scene is kept.
    """
    df = df.withColumns({"_s": F.greatest(F.lit(0), F.col("start_ms") - pad_ms).cast("long"), "_e": F.col("end_ms") + pad_ms})

    def step(state, s, e):
        if state is None or s - state[1] > gap_ms or e - state[0] > span_ms:
            return [s, e], (True,)
        return [state[0], max(state[1], e)], (False,)

    df = fold_rows(df, order, ["_s", "_e"], step, outputs(_new=BOOL), max_rows)
    df = islands(df, order, F.col("_new"), "scene")
    return df.groupBy(*order.keys, "scene").agg(
        F.min("_s").alias("start_ms"), F.max("_e").alias("end_ms"), F.count("*").alias("n_rows"), F.min("band").alias("band")
    )


def segment_scenes(
    df: DataFrame, order: Order, gap_ms: int = 4000, max_rows_in_scene: int = 24, max_chars: int = 12_000,
    explicit: str = "explicit_id", hint: str = "hint", max_rows: int = 1_000_000,
) -> DataFrame:
    """WIN6: per row its scene number and why the scene began.

    An explicit id that changes (or starts, or stops) is a boundary and an id that continues
    silences hints and gaps; then hard hints, then a gap above ``gap_ms``; the caps always win.
    """
    prev = F.struct(F.col(explicit).alias("x"), F.col("end_ms").alias("e"))
    df = neighbour(df, order, {"_p": prev})
    changed = ~F.col(explicit).eqNullSafe(F.col("_p.x"))
    soft = F.when(F.col("_p").isNull(), "start").when(changed, "explicit_scene_id").when(
        F.col(explicit).isNull(),
        F.when(F.col(hint).isNotNull(), F.concat(F.lit("scene_hint:"), F.col(hint))).when(
            F.col("start_ms") - F.col("_p.e") > gap_ms, "silence_gap"
        ),
    )
    df = df.withColumns({"_soft": soft, "_len": F.length("text").cast("long")}).drop("_p")

    def step(state, why, size):
        if state is None:
            return [1, size], (why or "start",)
        if state[0] >= max_rows_in_scene:
            return [1, size], ("forced_cap:max_units",)
        if state[1] + size > max_chars:
            return [1, size], ("forced_cap:max_source_characters",)
        if why is not None:
            return [1, size], (why,)
        return [state[0] + 1, state[1] + size], (None,)

    df = fold_rows(df, order, ["_soft", "_len"], step, outputs(boundary_before=STR), max_rows).drop("_soft", "_len")
    return islands(df, order, F.col("boundary_before").isNotNull(), "scene")


def scene_table(df: DataFrame, order: Order, explicit: str = "explicit_id") -> DataFrame:
    """WIN6 (scenes): one row per scene with its id, both boundary reasons and members."""
    by = F.struct(*order.by)
    scenes = df.groupBy(*order.keys, "scene").agg(
        F.min_by("seq", by).alias("first_seq"), F.max_by("seq", by).alias("last_seq"), F.min_by("start_ms", by).alias("start_ms"),
        F.max_by("end_ms", by).alias("end_ms"), F.count("*").alias("n_rows"), F.max("boundary_before").alias("boundary_before"),
        F.when(F.count_distinct(explicit) == 1, F.max(explicit)).alias("explicit"),
    )
    so = Order(order.keys, ("scene",))
    if order.chunk:
        scenes, so = chunked(scenes, so, 100_000)
    scenes = neighbour(scenes, so, {"boundary_after": F.col("boundary_before")}, following=True)
    scenes = scenes.withColumn("boundary_after", F.coalesce("boundary_after", F.lit("end")))
    part = Order((*order.keys, "explicit"), ("scene",), so.chunk)
    named = position(scenes.where("explicit is not null"), part, "_part")
    totals = named.groupBy(*part.keys).agg(F.count("*").alias("_parts"))
    named = named.join(totals, list(part.keys)).withColumn(
        "scene_id",
        F.when(F.col("_parts") == 1, F.col("explicit")).otherwise(F.concat("explicit", F.lit("--part-"), F.lpad(F.col("_part").cast("string"), 2, "0"))),
    )
    rest = scenes.where("explicit is null").withColumn("scene_id", F.concat(F.lit("scene-"), F.lpad(F.col("scene").cast("string"), 4, "0")))
    return named.drop("_part", "_parts").unionByName(rest).drop("_chunk")


def gap_or_count_batches(df: DataFrame, order: Order, gap_ms: int = 15_000, cap: int = 20) -> DataFrame:
    """WIN6 (simple form): a batch ends at a large gap or after ``cap`` rows - no loop needed."""
    df = neighbour(df, order, {"_pe": F.col("end_ms")})
    df = islands(df, order, F.col("_pe").isNull() | (F.col("start_ms") - F.col("_pe") > gap_ms), "island").drop("_pe")
    df = position(df, Order((*order.keys, "island"), order.by, order.chunk), "_at")
    return df.withColumn("batch", F.floor((F.col("_at") - 1) / cap)).drop("_at")


def size_batches(df: DataFrame, order: Order, rows: int, chars: int, max_rows: int = 1_000_000) -> DataFrame:
    """WIN6 (batch form): consecutive rows packed up to a row and a character limit."""
    df = df.withColumn("_len", F.length("text").cast("long"))

    def step(state, size):
        if state is None or state[0] >= rows or state[1] + size > chars:
            return [1, size], (True,)
        return [state[0] + 1, state[1] + size], (False,)

    df = fold_rows(df, order, ["_len"], step, outputs(_new=BOOL), max_rows)
    return islands(df, order, F.col("_new"), "batch").drop("_new", "_len")


def cluster_targets(
    df: DataFrame, order: Order, duration: Column, span_ms: int = 20_000, clip_ms: int = 28_000, max_rows: int = 1_000_000
) -> DataFrame:
    """WIN7: targets within ``span_ms`` of the cluster's first start share one centred clip."""
    def step(state, start, end):
        if state is None or end - state > span_ms:
            return start, (True,)
        return state, (False,)

    df = fold_rows(df, order, ["start_ms", "end_ms"], step, outputs(_new=BOOL), max_rows)
    df = islands(df, order, F.col("_new"), "cluster")
    by = F.struct(*order.by)
    out = df.groupBy(*order.keys, "cluster").agg(
        F.min_by("start_ms", by).alias("core_start"), F.max_by("end_ms", by).alias("core_end"), F.count("*").alias("targets")
    )
    first = F.greatest(F.lit(0), F.floor((F.col("core_start") + F.col("core_end") - clip_ms) / 2))
    out = out.withColumn("clip_end", F.least(duration, first + clip_ms))
    return out.withColumn("clip_start", F.greatest(F.lit(0), F.col("clip_end") - clip_ms))


def snap_windows(
    cuts: DataFrame, durations: DataFrame, keys: tuple[str, ...] = ("stream_id",), low_ms: int = 24_000, aim_ms: int = 26_000,
    high_ms: int = 28_000, overlap_ms: int = 2_000, max_rows: int = 1_000_000,
) -> DataFrame:
    """WIN10: cover ``[0, duration]`` with windows ending at the candidate nearest the aim.

    ``cuts``: keys and ``at_ms``.  A candidate seen past the window's limit closes it; no earlier
    candidate can matter to the next window, so one forward pass is enough.
    """
    ends = durations.where("duration_ms > 0")
    inside = cuts.join(ends, list(keys)).where("at_ms > 0 and at_ms < duration_ms").select(*keys, "at_ms", "duration_ms").distinct()
    marks = inside.withColumn("last", F.lit(0)).unionByName(
        ends.select(*keys, F.col("duration_ms").alias("at_ms"), "duration_ms", F.lit(1).alias("last"))
    )

    def step(state, at, total, last):
        begin, best = state or [0, None]
        made = []
        while total - begin > high_ms and at > begin + high_ms:
            cut = best if best is not None else begin + aim_ms
            made.append(cut)
            begin, best = cut - overlap_ms, None
        if total - begin > high_ms and not last and at >= begin + low_ms:
            if best is None or abs(at - begin - aim_ms) < abs(best - begin - aim_ms):
                best = at
        if last:
            made.append(total)
        return [begin, best], (made,)

    order = Order(keys, ("at_ms", "last"))
    cutd = fold_rows(marks, order, ["at_ms", "duration_ms", "last"], step, outputs(made=T.ArrayType(LONG)), max_rows)
    rows = cutd.select(*keys, F.explode("made").alias("core_end"))
    # windows are numbered in time chunks, so that no task sees a stream as a whole
    rows, so = chunked(rows, Order(keys, ("core_end",)), 100_000 * (aim_ms - overlap_ms))
    rows = position(rows, so, "window")
    rows = neighbour(rows, so, {"core_start": F.col("core_end")}).drop("_chunk")
    return rows.withColumn("core_start", F.coalesce("core_start", F.lit(0).cast("long"))).withColumn(
        "clip_start", F.greatest(F.lit(0).cast("long"), F.col("core_start") - overlap_ms)
    )


def group_items(
    df: DataFrame, order: Order, max_width: float = 42.0, longest_ms: int = 4500, sentence_ms: int = 1200,
    sentence_end: str = r"[.!?。！？]$", max_rows: int = 1_000_000,
) -> DataFrame:
    """WIN18: words grouped into segments; ``interval`` is the source interval of a word."""
    df = df.withColumns({"_w": tx.display_width(F.col("text")), "_stop": F.rtrim(F.col("text")).rlike(sentence_end)})

    def step(state, interval, start, end, width, stop):
        fresh = state is None or state[0] != interval
        if fresh:
            state = [interval, start, 0.0]
        total, span = state[2] + width, end - state[1]
        closed = total >= max_width or span >= longest_ms or (stop and span >= sentence_ms)
        return (None if closed else [interval, state[1], total]), (fresh,)

    df = fold_rows(df, order, ["interval", "start_ms", "end_ms", "_w", "_stop"], step, outputs(_new=BOOL), max_rows)
    df = islands(df, order, F.col("_new"), "segment")
    by = F.struct(*order.by)
    joined = F.array_join(F.array_sort(F.collect_list(F.struct(*order.by, "text")))["text"], "")
    out = df.groupBy(*order.keys, "segment").agg(
        F.min_by("start_ms", by).alias("start_ms"), F.max_by("end_ms", by).alias("end_ms"), joined.alias("text"), F.count("*").alias("items")
    )
    return out.withColumn("end_ms", F.greatest(F.col("end_ms"), F.col("start_ms") + 10)).where(F.trim("text") != "")


# --- retiming ------------------------------------------------------------------------------


def repair_durations(
    df: DataFrame, order: Order, longest_ms: int = 30_000, micro_ms: int = 250, target_ms: int = 500, least_ms: int = 80
) -> DataFrame:
    """WIN14: cap stale and reversed rows to reading time, lengthen tiny rows, cut overlaps.

    A stale row may not run past the next start that is strictly later, wherever it stands behind the row; starts need not rise.
    """
    df = neighbour(df, order, {"next_start": F.col("start_ms")}, following=True)
    span = F.col("end_ms") - F.col("start_ms")
    stale = (span > longest_ms) | (span <= 0)
    near = F.when(F.col("next_start") > F.col("start_ms"), F.col("next_start"))
    df = next_greater(df, order, "start_ms", stale & near.isNull() & F.col("next_start").isNotNull(), "_far")
    df = df.withColumn("_later", F.coalesce(near, "_far")).drop("_far")
    read = F.col("start_ms") + tx.reading_ms(F.col("text"))
    capped = F.greatest(F.least(read, F.coalesce("_later", read)), F.col("start_ms") + least_ms)
    df = df.withColumn("_end", F.when(stale, capped).otherwise(F.col("end_ms")))
    wish = F.least(F.col("start_ms") + target_ms, F.coalesce("next_start", F.col("start_ms") + target_ms))
    tiny = (F.col("_end") - F.col("start_ms") < micro_ms) & (wish > F.col("_end") + 1)
    df = df.withColumn("_end2", F.when(tiny, wish).otherwise(F.col("_end")))
    cut = (F.col("_end2") > F.col("next_start") + 1) & (F.col("next_start") > F.col("start_ms"))
    out = df.withColumn("new_end", F.when(F.coalesce(cut, F.lit(False)), F.col("next_start")).otherwise(F.col("_end2")))
    actions = F.array_compact(F.array(F.when(stale, "capped"), F.when(tiny, "extended"), F.when(cut, "clipped")))
    return out.withColumn("actions", actions).drop("next_start", "_later", "_end", "_end2")


def push_forward(df: DataFrame, order: Order, least_ms: int = 11, max_rows: int = 1_000_000) -> DataFrame:
    """WIN15: a row starting before the previous adjusted end moves to it, keeping a minimum length."""
    def step(state, start, end):
        first_end = end if end > start else start + least_ms
        begin = start if state is None else max(start, state)
        finish = first_end if first_end > begin else begin + least_ms
        return finish, (begin, finish, begin != start)

    out = fold_rows(df, order, ["start_ms", "end_ms"], step, outputs(new_start=LONG, new_end=LONG, pushed=BOOL), max_rows)
    return out


def non_overlapping(df: DataFrame, order: Order, least_ms: int = 10) -> DataFrame:
    """WIN15 (reference form): ends follow max(end, start+10, previous+10), a closed form."""
    df = position(df.where(F.trim("text") != ""), order, "_i")
    own = F.greatest(F.col("end_ms"), F.greatest(F.lit(0), F.col("start_ms")) + least_ms)
    df = running(df, order, {"_top": ("max", own - F.col("_i") * least_ms)})
    before = F.col("_top") + (F.col("_i") - 1) * least_ms
    start = F.greatest(F.lit(0).cast("long"), F.col("start_ms"), before)
    df = df.withColumn("new_start", start).withColumn("new_end", F.greatest(F.col("end_ms"), F.col("new_start") + least_ms))
    moved = (F.col("new_start") != F.col("start_ms")) | (F.col("new_end") != F.col("end_ms"))
    return df.withColumn("adjusted", moved).drop("_i", "_top")


def extend_into_silence(df: DataFrame, order: Order, least_ms: int = 800) -> DataFrame:
    """WIN15 (silence form): short rows grow into the free time after, then before them."""
    near = {"_ns": F.col("start_ms")}
    df = neighbour(df, order, near, following=True)
    need = F.greatest(F.lit(0), F.lit(least_ms) - (F.col("end_ms") - F.col("start_ms")))
    ahead = F.least(need, F.greatest(F.lit(0), F.coalesce(F.col("_ns") - F.col("end_ms"), F.lit(0))))
    df = df.withColumns({"_need": need - ahead, "new_end": F.col("end_ms") + ahead})
    df = neighbour(df, order, {"_pe": F.col("new_end")})
    back = F.least(F.col("_need"), F.greatest(F.lit(0), F.coalesce(F.col("start_ms") - F.col("_pe"), F.lit(0))))
    df = df.withColumn("new_start", F.col("start_ms") - back)
    return df.withColumn("still_short", F.col("new_end") - F.col("new_start") < least_ms).drop("_ns", "_need", "_pe")


def interpolate_starts(df: DataFrame, order: Order, anchor: str, lower: Column, upper: Column, step_ms: int = 50) -> DataFrame:
    """WIN17: starts between known anchors by linear interpolation on the row index.

    Streams without an anchor give null.  The monotone rule "at least the previous start plus
    the step" is the running maximum of ``start - step * i``.
    """
    df = position(df, order, "_i")
    known = F.when(F.col(anchor).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(anchor).cast("double").alias("t")))
    df = running(df, order, {"_a": ("last", known)}, inclusive=True)
    df = running(df, order, {"_b": ("last", known)}, inclusive=True, reverse=True)
    count = df.groupBy(*order.keys).agg(F.max("_i").alias("_n"))
    df = df.join(count, list(order.keys))
    i, a, b = F.col("_i"), F.col("_a"), F.col("_b")
    head = lower + F.greatest(F.lit(100.0), b["t"] - lower) * i / b["i"]
    tail = a["t"] + F.greatest(F.lit(100.0), upper - a["t"]) * (i - a["i"]) / (F.col("_n") - a["i"] + 1)
    mid = F.when(a["i"] == b["i"], a["t"]).otherwise(a["t"] + (b["t"] - a["t"]) * (i - a["i"]) / (b["i"] - a["i"]))
    raw = F.when(a.isNull() & b.isNull(), None).when(a.isNull(), head).when(b.isNull(), tail).otherwise(mid)
    df = df.withColumn("_raw", raw)
    df = running(df, order, {"_m": ("max", F.col("_raw") - i * step_ms)}, inclusive=True)
    return df.withColumn("new_start", F.col("_m") + i * step_ms).drop("_i", "_a", "_b", "_n", "_raw", "_m")


def split_layout(df: DataFrame, limit: int = 42) -> DataFrame:
    """WIN16: rows with too long or too many lines become several two-line rows of equal time."""
    columns = df.columns
    df = df.withColumn("_value", tx.squeeze(F.col("text")))
    value = F.col("_value")
    lines = tx.lines(F.col("text"))
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    fits = (F.size(lines) <= 2) & (longest <= limit)
    words = F.split(value, " ")
    two = 2 * limit
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.length(value), F.lit(1)) - 1) / two)), lambda i: F.substring(value, i * two + 1, F.lit(two))
    )
    chunks = F.when(F.length(value) <= two, F.array(value)).when(F.size(words) == 1, pieces).otherwise(tx.pack_words(value, F.lit(two)))

    parts = F.when(fits, F.array(F.col("text"))).otherwise(chunks)
    # the whole text stays behind: every piece carries only itself
    kept = [c for c in columns if c != "text"]
    out = df.withColumns({"_fits": fits, "_parts": parts}).withColumn("_n", F.size("_parts"))
    out = out.select(*kept, "_fits", "_n", F.posexplode("_parts").alias("part", "_piece"))

    # squeezed text has single spaces, so only splits this close to the limits can fit both lines
    chunk, size = F.col("_piece"), F.length("_piece")

    def left(i: Column) -> Column:
        return F.rtrim(F.substring(chunk, F.lit(1), i))

    def right(i: Column) -> Column:
        return F.ltrim(F.substring(chunk, i + 1, size))

    low = F.greatest(F.lit(1), size - limit - 1)
    spots = F.transform(
        F.sequence(low, F.greatest(low, F.least(size - 1, F.lit(limit + 1)))),
        lambda i: F.struct(i.alias("i"), F.length(left(i)).alias("l"), F.length(right(i)).alias("r"), F.substring(chunk, i, F.lit(1)).alias("c")),
    )
    fitting = F.filter(spots, lambda x: (x["l"] <= limit) & (x["r"] <= limit))
    ranked = F.transform(
        fitting,
        lambda x: F.struct(
            F.when(x["c"].isin(*" ,.?!…"), 0).otherwise(1).alias("p"), F.greatest(x["l"], x["r"]).alias("m"),
            F.abs(x["l"] - x["r"]).alias("d"), x["i"].alias("i"),
        ),
    )
    out = out.withColumn("_at", F.when(~F.col("_fits") & (size > limit), F.array_min(ranked)["i"]))
    at = F.col("_at")
    span = F.col("end_ms") - F.col("start_ms")
    return out.withColumns(
        {
            "new_start": F.col("start_ms") + F.floor(span * F.col("part") / F.col("_n")),
            "new_end": F.col("start_ms") + F.floor(span * (F.col("part") + 1) / F.col("_n")),
            "text": F.when(at.isNull(), chunk).otherwise(F.concat(left(at), F.lit("\n"), right(at))),
            "too_short": span < F.col("_n") * 40,
        }
    ).drop("_n", "_piece", "_fits", "_at")


# --- structure audits ----------------------------------------------------------------------


def structure_issues(df: DataFrame, order: Order, reference: DataFrame | None = None) -> DataFrame:
    """AUD2: long table of numbering, reversed-time and overlap issues.

    ``order`` is file order.  An overlap already present at the same number in ``reference`` is
    only a warning.
    """
    def overlaps(rows: DataFrame) -> DataFrame:
        return running(rows, order, {"_reach": ("max", F.col("end_ms"))})

    numbered = position(overlaps(df), order, "_pos")
    known = overlaps(reference if reference is not None else df).where(F.col("start_ms") < F.col("_reach"))
    known = known.select(*order.keys, "seq", F.lit(True).alias("_known")).distinct()
    twice = df.groupBy(*order.keys, "seq").agg(F.count("*").alias("_times"))
    rows = numbered.join(known, [*order.keys, "seq"], "left").join(twice, [*order.keys, "seq"])

    def issue(code: str, severity: Column | str) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.struct(F.lit(code).alias("code"), level.alias("severity"))

    hit = F.col("start_ms") < F.col("_reach")
    issues = F.array_compact(
        F.array(
            F.when(F.col("_times") > 1, issue("duplicate_number", "error")),
            F.when(F.col("seq") != F.col("_pos"), issue("number_not_in_sequence", "error")),
            F.when(F.col("end_ms") < F.col("start_ms"), issue("reversed_time", "error")),
            F.when(hit, issue("overlap", F.when(F.col("_known"), "warning").otherwise("error"))),
        )
    )
    return rows.select(*order.keys, "seq", F.col("_pos").alias("row_no"), F.explode(issues).alias("i")).select(
        *order.keys, "seq", "row_no", "i.code", "i.severity"
    )


def cue_validity(df: DataFrame, order: Order, tolerance_ms: int = 1) -> DataFrame:
    """AUD3: per stream counts of id breaks, non-positive, overlapping, empty and missing-time cues.

    A cue overlaps if it starts before the latest end of all cues before it.
    """
    rows = running(position(df, order, "_pos"), order, {"_pe": ("max", F.col("end_ms"))})

    def times(c: Column) -> Column:
        return F.count(F.when(c, 1))

    return rows.groupBy(*order.keys).agg(
        F.count("*").alias("cues"),
        times(F.col("seq") != F.col("_pos")).alias("id_breaks"),
        times(F.col("end_ms") <= F.col("start_ms")).alias("non_positive"),
        times(F.col("start_ms") < F.col("_pe") - tolerance_ms).alias("overlaps"),
        times(F.trim("text") == "").alias("empty_text"),
        times(F.col("start_ms").isNull() | F.col("end_ms").isNull()).alias("non_finite"),
    ).withColumn(
        "valid", (F.col("id_breaks") + F.col("non_positive") + F.col("overlaps") + F.col("empty_text") + F.col("non_finite")) == 0
    )


def transcript_warnings(df: DataFrame, order: Order, period_ms: int = 10_000, min_len: int = 4) -> DataFrame:
    """AUD4: warning codes per segment.

    Uses ``compression_ratio``, ``avg_logprob``, ``no_speech_prob``.  Exact repeats compare with
    the previous non-empty text; periodic repeats with the last row of the same text.
    """
    key = tx.squeeze(F.col("text"))
    df = df.withColumn("_key", key)
    df = running(df, order, {"_ptext": ("last", F.when(F.col("_key") != "", F.col("_key")))})
    # rows of one text are a stream of their own; its chunk still follows time
    again = Order((*order.keys, "_key"), order.by, order.chunk)
    df = neighbour(df, again, {"_pstart": F.col("start_ms")})
    long_enough = F.length("_key") >= min_len
    codes = F.array_compact(
        F.array(
            F.when(F.col("_key") == "", "empty_text"),
            F.when(F.col("compression_ratio") > 2.6, "high_compression_ratio"),
            F.when(F.col("avg_logprob") < -1.0, "low_average_logprob"),
            F.when((F.col("no_speech_prob") > 0.65) & (F.col("_key") != ""), "speech_in_no_speech_region"),
            F.when(tx.has_runaway(F.col("text")), "possible_runaway_repetition"),
            F.when(long_enough & (F.col("_key") == F.col("_ptext")), "exact_adjacent_repeat"),
            F.when(long_enough & (F.col("start_ms") - F.col("_pstart") >= period_ms), "periodic_repeat"),
        )
    )
    return df.withColumn("warnings", F.array_sort(codes)).drop("_key", "_ptext", "_pstart")


def partition_issues(groups: DataFrame, rows: DataFrame, order: Order) -> DataFrame:
    """WIN20: groups must list every row once, in order, and carry its first start and last end.

    ``groups``: keys, ``group_no``, ``members`` (array of seq), ``start_ms``, ``end_ms``.
    """
    keys = list(order.keys)
    listed = groups.select(*keys, "group_no", F.posexplode("members").alias("_at", "seq"))
    listed, go = chunked(listed, Order((*keys,), ("group_no", "_at")), 1000)
    listed = position(listed, go, "_gpos").drop("_chunk")
    truth = position(rows.select(*order.part, *[c for c in dict.fromkeys([*order.by, "seq", "start_ms", "end_ms"]) if c not in order.part]), order, "_pos")
    both = listed.join(truth, [*keys, "seq"], "full_outer")
    times = listed.groupBy(*keys, "seq").agg(F.count("*").alias("_times")).where("_times > 1")
    both = both.join(times, [*keys, "seq"], "left")
    code = (
        F.when(F.col("_pos").isNull(), "unknown_row").when(F.col("_gpos").isNull(), "missing_row")
        .when(F.col("_times").isNotNull(), "repeated_row").when(F.col("_gpos") != F.col("_pos"), "out_of_order")
    )
    row_issues = both.where(code.isNotNull()).select(*keys, F.col("group_no"), F.col("seq"), code.alias("code"))
    ends = listed.join(truth, [*keys, "seq"]).groupBy(*keys, "group_no").agg(
        F.min_by("start_ms", "_gpos").alias("_s"), F.max_by("end_ms", "_gpos").alias("_e")
    )
    edge = groups.join(ends, [*keys, "group_no"]).where("start_ms <> _s or end_ms <> _e")
    return row_issues.unionByName(edge.select(*keys, "group_no", F.lit(None).cast("long").alias("seq"), F.lit("edge_mismatch").alias("code")))
