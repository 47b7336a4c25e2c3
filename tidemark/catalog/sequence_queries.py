"""Sequence operators on document lines, conversation turns and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.frames import (
    DAY, EV, HOUR, LINE_ORDER, LN, MONTH, TN, chunked_events, events, lines, sql_compact, sql_jaccard, sql_key, sql_squeeze, sql_width, table, turns, with_,
)
from tidemark.catalog.interval_queries import MERGE, durations
from tidemark.catalog.registry import query
from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded
from tidemark.operators import sequences as sq
from tidemark.operators.ordered import Order, chunked, context

L = F.lit
TURN_ORDER = Order(by=("seq",))


def rec(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def numbered(src: str, by: str = "start_ms, end_ms, seq") -> str:
    return f"nb AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY {by}) AS rn FROM {src})"


RUNS = f"""kk AS (SELECT *, {sql_key('text')} AS key FROM ln),
k2 AS (SELECT *, lag(key) OVER (PARTITION BY stream_id ORDER BY seq) AS pk FROM kk),
k3 AS (SELECT *, sum(CASE WHEN pk IS NULL OR pk <> key OR key = '' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM k2)"""


@query("win1_run_length", with_(LN, RUNS) + """
SELECT stream_id, seq, CASE WHEN key = '' THEN 0 ELSE count(*) OVER (PARTITION BY stream_id, run) END AS run_length,
  CASE WHEN key <> '' THEN min(seq) OVER (PARTITION BY stream_id, run) END AS run_start FROM k3""")
def win1(spark, sf):
    out = sq.runs(lines(spark, sf), LINE_ORDER, tx.word_key(F.col("text")))
    return out.select("stream_id", "seq", F.col("run_length").cast("long").alias("run_length"), "run_start")


@query("win1_longest_run_per_stream", with_(LN, RUNS) + """,
r AS (SELECT stream_id, run, min(key) AS key, count(*) AS n, min(seq) AS s FROM k3 WHERE key <> '' GROUP BY stream_id, run)
SELECT stream_id, max(n) AS longest_run, arg_min(key, (-n, s)) AS run_text FROM r GROUP BY stream_id""")
def win1b(spark, sf):
    out = sq.runs(lines(spark, sf), LINE_ORDER, tx.word_key(F.col("text"))).where("run_length > 0 and seq = run_start")
    best = F.struct((-F.col("run_length")).alias("n"), F.col("run_start"))
    return out.groupBy("stream_id").agg(
        F.max("run_length").cast("long").alias("longest_run"), F.min_by("run_key", best).alias("run_text")
    )


@query("win2_order_flags", with_(EV) + """,
p AS (SELECT *, lag(text) OVER w AS pt, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY seq))
SELECT stream_id, seq, coalesce(text <> '' AND pt = text, false) AS adjacent_duplicate,
  coalesce(start_ms < ps, false) AS out_of_order, coalesce(start_ms < pe, false) AS overlaps_previous FROM p""")
def win2(spark, sf):
    ev, order = chunked(events(spark, sf), Order(by=("seq",)), 2500)
    out = sq.order_flags(ev, order, F.col("text"))
    return out.select("stream_id", "seq", "adjacent_duplicate", "out_of_order", "overlaps_previous")


@query("win5_padded_sessions", rec(EV, numbered("ev"), f"""r AS (
  SELECT stream_id, rn, greatest(0, start_ms - 600000) AS s, end_ms + 600000 AS e, 1 AS scene, start_ms, end_ms, cents FROM nb WHERE rn = 1
  UNION ALL
  SELECT n.stream_id, n.rn,
    CASE WHEN n.x THEN greatest(0, n.start_ms - 600000) ELSE n.ps END, CASE WHEN n.x THEN n.end_ms + 600000 ELSE greatest(n.pe, n.end_ms + 600000) END,
    n.sc + CASE WHEN n.x THEN 1 ELSE 0 END, n.start_ms, n.end_ms, n.cents
  FROM (SELECT b.*, r.s AS ps, r.e AS pe, r.scene AS sc,
        greatest(0, b.start_ms - 600000) - r.e > {2 * HOUR} OR b.end_ms + 600000 - r.s > {12 * HOUR} AS x
        FROM r JOIN nb b ON b.stream_id = r.stream_id AND b.rn = r.rn + 1) n)""") + """
SELECT stream_id, CAST(scene AS BIGINT) AS scene, CAST(min(greatest(0, start_ms - 600000)) AS BIGINT) AS start_ms, max(end_ms + 600000) AS end_ms, count(*) AS n_rows,
  min(cents % 4 + 1) AS band FROM r GROUP BY stream_id, scene""")
def win5(spark, sf):
    ev, order = chunked_events(events(spark, sf).withColumn("band", F.col("cents") % 4 + 1))
    out = sq.padded_sessions(ev, order, 600_000, 2 * HOUR, 12 * HOUR)
    return out.select("stream_id", "scene", "start_ms", "end_ms", "n_rows", "band")


def marked_lines(spark, sf):
    explicit = F.when((F.col("seq") % 9).isin(3, 4, 5), F.concat(L("x"), (F.floor(F.col("seq") / 9) % 2).cast("string")))
    hint = F.when(F.length("text") % 7 == 0, "len7")
    return lines(spark, sf).withColumns({"explicit_id": explicit, "hint": hint})


SCENES = rec(LN, """mk AS (SELECT *, CASE WHEN seq % 9 IN (3, 4, 5) THEN 'x' || CAST(seq // 9 % 2 AS VARCHAR) END AS explicit_id,
    CASE WHEN length(text) % 7 = 0 THEN 'len7' END AS hint FROM ln)""", """nb AS (
  SELECT *, length(text) AS size, CASE WHEN seq = 1 THEN 'start' WHEN explicit_id IS DISTINCT FROM lag(explicit_id) OVER w THEN 'explicit_scene_id'
     WHEN explicit_id IS NULL THEN CASE WHEN hint IS NOT NULL THEN 'scene_hint:' || hint WHEN start_ms - lag(end_ms) OVER w > 1500 THEN 'silence_gap' END END AS why
  FROM mk WINDOW w AS (PARTITION BY stream_id ORDER BY seq))""", """r AS (
  SELECT stream_id, seq, 1 AS n, size AS c, why AS b FROM nb WHERE seq = 1
  UNION ALL
  SELECT x.stream_id, x.seq, CASE WHEN x.b IS NULL THEN x.n + 1 ELSE 1 END, CASE WHEN x.b IS NULL THEN x.c + x.size ELSE x.size END, x.b
  FROM (SELECT k.stream_id, k.seq, k.size, r.n, r.c, CASE WHEN r.n >= 4 THEN 'forced_cap:max_units' WHEN r.c + k.size > 900 THEN 'forced_cap:max_source_characters' ELSE k.why END AS b
        FROM r JOIN nb k ON k.stream_id = r.stream_id AND k.seq = r.seq + 1) x)""",
    "sc AS (SELECT stream_id, seq, b, sum(CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS scene FROM r)")


@query("win6_scene_boundaries", SCENES + "SELECT stream_id, seq, b AS boundary_before, CAST(scene AS BIGINT) AS scene FROM sc")
def win6(spark, sf):
    return sq.segment_scenes(marked_lines(spark, sf), LINE_ORDER, 1500, 4, 900).select("stream_id", "seq", "boundary_before", "scene")


@query("win6_scene_table", SCENES + """,
g AS (SELECT s.stream_id, scene, min(s.seq) AS first_seq, max(s.seq) AS last_seq, count(*) AS n_rows, max(b) AS boundary_before,
   CASE WHEN count(DISTINCT explicit_id) = 1 THEN max(explicit_id) END AS x FROM sc s JOIN mk m ON s.stream_id = m.stream_id AND s.seq = m.seq GROUP BY s.stream_id, scene)
SELECT stream_id, CAST(scene AS BIGINT) AS scene, first_seq, last_seq, n_rows, boundary_before,
  coalesce(lead(boundary_before) OVER (PARTITION BY stream_id ORDER BY scene), 'end') AS boundary_after,
  CASE WHEN x IS NULL THEN 'scene-' || lpad(CAST(scene AS VARCHAR), 4, '0')
       WHEN count(*) OVER (PARTITION BY stream_id, x) = 1 THEN x
       ELSE x || '--part-' || lpad(CAST(row_number() OVER (PARTITION BY stream_id, x ORDER BY scene) AS VARCHAR), 2, '0') END AS scene_id FROM g""")
def win6b(spark, sf):
    rows = sq.segment_scenes(marked_lines(spark, sf), LINE_ORDER, 1500, 4, 900)
    return sq.scene_table(rows, LINE_ORDER).select(
        "stream_id", "scene", "first_seq", "last_seq", "n_rows", "boundary_before", "boundary_after", "scene_id"
    )


@query("win6_gap_or_count_batches", with_(EV) + f""",
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms - pe > {10 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, seq ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, lag(end_ms) OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, seq) AS pe FROM ev))
SELECT stream_id, seq, CAST(island AS BIGINT) AS island, CAST((row_number() OVER (PARTITION BY stream_id, island ORDER BY start_ms, end_ms, seq) - 1) // 3 AS BIGINT) AS batch FROM i""")
def win6c(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    return sq.gap_or_count_batches(ev, order, 10 * HOUR, 3).select("stream_id", "seq", "island", F.col("batch").cast("long").alias("batch"))


@query("win6_size_batches", rec(LN, "nb AS (SELECT *, length(text) AS size FROM ln)", """r AS (
  SELECT stream_id, seq, 1 AS n, size AS c, 1 AS batch FROM nb WHERE seq = 1
  UNION ALL
  SELECT x.stream_id, x.seq, CASE WHEN x.z THEN 1 ELSE x.n + 1 END, CASE WHEN x.z THEN x.size ELSE x.c + x.size END, x.batch + CASE WHEN x.z THEN 1 ELSE 0 END
  FROM (SELECT k.*, r.n, r.c, r.batch, r.n >= 8 OR r.c + k.size > 1200 AS z FROM r JOIN nb k ON k.stream_id = r.stream_id AND k.seq = r.seq + 1) x)""") + """
SELECT stream_id, CAST(batch AS BIGINT) AS batch, min(seq) AS first_seq, max(seq) AS last_seq FROM r GROUP BY stream_id, batch""")
def win6d(spark, sf):
    out = sq.size_batches(lines(spark, sf), LINE_ORDER, 8, 1200)
    return out.groupBy("stream_id", "batch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("win7_target_clusters", rec(EV, "er AS (SELECT * FROM ev WHERE family = 'error')", numbered("er"), f"""r AS (
  SELECT stream_id, rn, start_ms AS f, 1 AS cl, start_ms, end_ms FROM nb WHERE rn = 1
  UNION ALL
  SELECT n.stream_id, n.rn, CASE WHEN n.end_ms - r.f > {20 * HOUR} THEN n.start_ms ELSE r.f END, r.cl + CASE WHEN n.end_ms - r.f > {20 * HOUR} THEN 1 ELSE 0 END, n.start_ms, n.end_ms
  FROM r JOIN nb n ON n.stream_id = r.stream_id AND n.rn = r.rn + 1)""", """g AS (
  SELECT stream_id, cl, arg_min(start_ms, rn) AS core_start, arg_max(end_ms, rn) AS core_end, count(*) AS targets FROM r GROUP BY stream_id, cl)""") + f"""
SELECT stream_id, CAST(cl AS BIGINT) AS cluster, core_start, core_end, targets,
  CAST(greatest(0, least({MONTH}, greatest(0, floor((core_start + core_end - {28 * HOUR}) / 2)) + {28 * HOUR}) - {28 * HOUR}) AS BIGINT) AS clip_start,
  CAST(least({MONTH}, greatest(0, floor((core_start + core_end - {28 * HOUR}) / 2)) + {28 * HOUR}) AS BIGINT) AS clip_end FROM g""")
def win7(spark, sf):
    ev, order = chunked_events(events(spark, sf).where("family = 'error'"))
    out = sq.cluster_targets(ev, order, L(MONTH), 20 * HOUR, 28 * HOUR)
    return out.select("stream_id", "cluster", "core_start", "core_end", "targets",
                      F.col("clip_start").cast("long").alias("clip_start"), F.col("clip_end").cast("long").alias("clip_end"))


@query("win10_snap_windows", rec(EV, f"""c AS (SELECT stream_id, list_sort(list(DISTINCT end_ms)) AS ct FROM ev WHERE end_ms > 0 AND end_ms < {MONTH} GROUP BY stream_id)""", f"""r AS (
  SELECT stream_id, 0 AS w, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS core_start, CAST(NULL AS BIGINT) AS cut, ct FROM c
  UNION ALL
  SELECT stream_id, w + 1, z - {2 * HOUR}, coalesce(cut, 0), z, ct FROM (SELECT *, CASE WHEN {MONTH} - b <= {28 * HOUR} THEN {MONTH}
     ELSE coalesce(list_sort(list_transform(list_filter(ct, lambda t: t >= b + {24 * HOUR} AND t <= b + {28 * HOUR}), lambda t: {{'d': abs(t - b - {26 * HOUR}), 't': t}}))[1].t, b + {26 * HOUR}) END AS z
   FROM r WHERE cut IS NULL OR cut < {MONTH}))""") + f"""
SELECT stream_id, CAST(w AS BIGINT) AS window_no, core_start, cut AS core_end, CAST(greatest(0, core_start - {2 * HOUR}) AS BIGINT) AS clip_start FROM r WHERE w > 0""")
def win10(spark, sf):
    ev = events(spark, sf)
    cuts = ev.select("stream_id", F.col("end_ms").alias("at_ms"))
    out = sq.snap_windows(cuts, durations(ev), low_ms=24 * HOUR, aim_ms=26 * HOUR, high_ms=28 * HOUR, overlap_ms=2 * HOUR)
    return out.select("stream_id", F.col("window").alias("window_no"), "core_start", "core_end", "clip_start")


@query("win12_keep_first")
def win12(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    return sq.keep_first(ev, order, "sequence", 0.8, 0.1, 100, 6, 3 * HOUR, width_ms=6 * HOUR).select("stream_id", "seq")


def keep_sql(fits: str, view: str) -> str:
    """Greedy suppression row by row: ``x`` is a kept row, ``n`` the new one, ``view`` the kept rows it looks at."""
    return rec(EV, numbered("ev"), f"""r AS (
  SELECT stream_id, rn, seq, true AS keep, [{{'s': start_ms, 'e': end_ms, 'f': family, 't': text}}] AS kept FROM nb WHERE rn = 1
  UNION ALL
  SELECT stream_id, rn, seq, NOT dup, CASE WHEN dup THEN kept ELSE list_append(kept, {{'s': start_ms, 'e': end_ms, 'f': family, 't': text}}) END FROM (
    SELECT n.*, r.kept, len(list_filter({view}, lambda x: {fits})) > 0 AS dup FROM r JOIN nb n ON n.stream_id = r.stream_id AND n.rn = r.rn + 1))""") + "SELECT stream_id, seq FROM r WHERE keep"


OVERLAPS = "least(n.end_ms, x.e) - greatest(n.start_ms, x.s) >= 0.1 * greatest(100, least(n.end_ms - n.start_ms, x.e - x.s)) AND x.f = n.family AND " + sql_jaccard("n.text", "x.t") + " >= 0.8"
# of the last six, those after the last one that ended too long ago
LAST_SIX = f"list_filter(r.kept[-6:], lambda y, i: i > coalesce(list_max(list_transform(r.kept[-6:], lambda z, j: CASE WHEN n.start_ms - z.e > {3 * HOUR} THEN j END)), 0))"


@query("win12_keep_first_bigram_all_kept", keep_sql(OVERLAPS, "r.kept"))
def win12b(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    return sq.keep_first(ev, order, "bigram", 0.8, 0.1, 100, None, None, width_ms=6 * HOUR).select("stream_id", "seq")


@query("win12_keep_first_bigram_last_six", keep_sql(OVERLAPS, LAST_SIX))
def win12c(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    return sq.keep_first(ev, order, "bigram", 0.8, 0.1, 100, 6, 3 * HOUR, width_ms=6 * HOUR).select("stream_id", "seq")


@query("win12_keep_first_near_starts", keep_sql(f"abs(n.start_ms - x.s) < {12 * HOUR} AND " + sql_jaccard("n.text", "x.t") + " > 0.72", "r.kept[-5:]"))
def win12d(spark, sf):
    """The form without families: the last five kept rows, by the distance of starts."""
    ev, order = chunked_events(events(spark, sf))
    out = sq.keep_first(ev, order, "bigram", 0.72, lookback=5, max_apart_ms=None, same=(), start_within_ms=12 * HOUR, above=True, width_ms=12 * HOUR)
    return out.select("stream_id", "seq")


@query("win13_merge_equal_text", with_(LN, f"""a AS (SELECT *, lag({sql_squeeze('text')}) OVER (PARTITION BY stream_id ORDER BY seq) AS pt FROM ln),
b AS (SELECT *, sum(CASE WHEN pt IS NULL OR pt <> {sql_squeeze('text')} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM a),
c AS (SELECT *, max(end_ms) OVER (PARTITION BY stream_id, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
d AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + 900 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, g ORDER BY seq ROWS UNBOUNDED PRECEDING) AS h FROM c)""") + """
SELECT stream_id, min(seq) AS seq, arg_min(start_ms, seq) AS start_ms, max(end_ms) AS end_ms, count(*) AS merged_rows FROM d GROUP BY stream_id, g, h""")
def win13(spark, sf):
    return sq.merge_equal_text(lines(spark, sf), LINE_ORDER, 900).select("stream_id", "seq", "start_ms", "end_ms", "merged_rows")


READ = f"CAST(least(8000, greatest(1000, floor(length({sql_compact('text')}) * 1000 / 7) + 800)) AS BIGINT)"


@query("win14_repair_durations", with_(LN, f"""a AS (SELECT *, lead(start_ms) OVER (PARTITION BY stream_id ORDER BY seq) AS nx FROM ln),
b AS (SELECT *, (end_ms - start_ms > 6000 OR end_ms <= start_ms) AS stale FROM a),
c AS (SELECT *, CASE WHEN stale THEN greatest(least(start_ms + {READ}, coalesce(nx, start_ms + {READ})), start_ms + 80) ELSE end_ms END AS e1 FROM b),
d AS (SELECT *, (e1 - start_ms < 900 AND least(start_ms + 1200, coalesce(nx, start_ms + 1200)) > e1 + 1) AS tiny FROM c),
e AS (SELECT *, CASE WHEN tiny THEN least(start_ms + 1200, coalesce(nx, start_ms + 1200)) ELSE e1 END AS e2 FROM d),
f AS (SELECT *, coalesce(e2 > nx + 1 AND nx > start_ms, false) AS cut FROM e)""") + """
SELECT stream_id, seq, CASE WHEN cut THEN nx ELSE e2 END AS new_end,
  array_to_string(list_filter([CASE WHEN stale THEN 'capped' END, CASE WHEN tiny THEN 'extended' END, CASE WHEN cut THEN 'clipped' END], lambda x: x IS NOT NULL), ',') AS actions FROM f""")
def win14(spark, sf):
    out = sq.repair_durations(lines(spark, sf), LINE_ORDER, 6000, 900, 1200, 80)
    return out.select("stream_id", "seq", F.col("new_end").cast("long").alias("new_end"), F.array_join("actions", ",").alias("actions"))


@query("win14_repair_durations_out_of_order", with_(LN, f"""w AS (SELECT stream_id, seq, CASE WHEN seq % 5 = 0 THEN start_ms - 9000 WHEN seq % 7 = 0 THEN start_ms + 20000 ELSE start_ms END AS start_ms,
  CASE WHEN seq % 3 = 0 THEN start_ms + 40000 ELSE end_ms END AS end_ms, text FROM ln),
far AS (SELECT x.stream_id, x.seq, arg_min(y.start_ms, y.seq) AS later FROM w x JOIN w y ON x.stream_id = y.stream_id AND y.seq > x.seq AND y.start_ms > x.start_ms GROUP BY x.stream_id, x.seq),
a AS (SELECT w.*, lead(start_ms) OVER (PARTITION BY stream_id ORDER BY seq) AS nx, later FROM w LEFT JOIN far USING (stream_id, seq)),
b AS (SELECT *, (end_ms - start_ms > 6000 OR end_ms <= start_ms) AS stale FROM a),
c AS (SELECT *, CASE WHEN stale THEN greatest(least(start_ms + {READ}, coalesce(later, start_ms + {READ})), start_ms + 80) ELSE end_ms END AS e1 FROM b),
d AS (SELECT *, (e1 - start_ms < 900 AND least(start_ms + 1200, coalesce(nx, start_ms + 1200)) > e1 + 1) AS tiny FROM c),
e AS (SELECT *, CASE WHEN tiny THEN least(start_ms + 1200, coalesce(nx, start_ms + 1200)) ELSE e1 END AS e2 FROM d),
f AS (SELECT *, coalesce(e2 > nx + 1 AND nx > start_ms, false) AS cut FROM e)""") + """
SELECT stream_id, seq, CASE WHEN cut THEN nx ELSE e2 END AS new_end,
  array_to_string(list_filter([CASE WHEN stale THEN 'capped' END, CASE WHEN tiny THEN 'extended' END, CASE WHEN cut THEN 'clipped' END], lambda x: x IS NOT NULL), ',') AS actions FROM f""")
def win14b(spark, sf):
    """Starts that jump back and forth: the next strictly later start may stand anywhere behind the row."""
    seq = F.col("seq")
    start = F.when(seq % 5 == 0, F.col("start_ms") - 9000).when(seq % 7 == 0, F.col("start_ms") + 20000).otherwise(F.col("start_ms"))
    rows = lines(spark, sf).withColumns({"start_ms": start, "end_ms": F.when(seq % 3 == 0, F.col("start_ms") + 40000).otherwise(F.col("end_ms"))})
    out = sq.repair_durations(rows, LINE_ORDER, 6000, 900, 1200, 80)
    return out.select("stream_id", "seq", "new_end", F.array_join("actions", ",").alias("actions"))


@query("win15_push_forward", rec(EV, numbered("ev"), """r AS (
  SELECT stream_id, rn, seq, start_ms AS s, CASE WHEN end_ms > start_ms THEN end_ms ELSE start_ms + 11 END AS e, false AS pushed FROM nb WHERE rn = 1
  UNION ALL
  SELECT n.stream_id, n.rn, n.seq, greatest(n.start_ms, r.e), CASE WHEN greatest(n.end_ms, n.start_ms) > greatest(n.start_ms, r.e) THEN n.end_ms
     WHEN n.end_ms <= n.start_ms AND n.start_ms >= r.e THEN n.start_ms + 11 ELSE greatest(n.start_ms, r.e) + 11 END, greatest(n.start_ms, r.e) <> n.start_ms
  FROM r JOIN nb n ON n.stream_id = r.stream_id AND n.rn = r.rn + 1)""") + "SELECT stream_id, seq, s AS new_start, e AS new_end, pushed FROM r")
def win15(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    return sq.push_forward(ev, order).select("stream_id", "seq", "new_start", "new_end", "pushed")


@query("win15_non_overlapping", rec(EV, numbered("ev"), """r AS (
  SELECT stream_id, rn, seq, greatest(0, start_ms) AS s, greatest(end_ms, greatest(0, start_ms) + 10) AS e, start_ms, end_ms FROM nb WHERE rn = 1
  UNION ALL
  SELECT n.stream_id, n.rn, n.seq, greatest(0, n.start_ms, r.e), greatest(n.end_ms, greatest(0, n.start_ms, r.e) + 10), n.start_ms, n.end_ms
  FROM r JOIN nb n ON n.stream_id = r.stream_id AND n.rn = r.rn + 1)""") + """
SELECT stream_id, seq, CAST(s AS BIGINT) AS new_start, CAST(e AS BIGINT) AS new_end, (s <> start_ms OR e <> end_ms) AS adjusted FROM r""")
def win15b(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    out = sq.non_overlapping(ev, order)
    return out.select("stream_id", "seq", "new_start", "new_end", "adjusted")


@query("win15_extend_into_silence", with_(EV, f"""a AS (SELECT *, lead(start_ms) OVER w AS nx FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY start_ms, end_ms, seq)),
b AS (SELECT *, greatest(0, {2 * HOUR} - (end_ms - start_ms)) AS need FROM a),
c AS (SELECT *, least(need, greatest(0, coalesce(nx - end_ms, 0))) AS ahead FROM b),
d AS (SELECT *, lag(end_ms + ahead) OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, seq) AS pe FROM c),
e AS (SELECT *, least(need - ahead, greatest(0, coalesce(start_ms - pe, 0))) AS back FROM d)""") + f"""
SELECT stream_id, seq, CAST(start_ms - back AS BIGINT) AS new_start, CAST(end_ms + ahead AS BIGINT) AS new_end,
  end_ms + ahead - (start_ms - back) < {2 * HOUR} AS still_short FROM e""")
def win15c(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    out = sq.extend_into_silence(ev, order, 2 * HOUR)
    return out.select("stream_id", "seq", "new_start", "new_end", "still_short")


@query("win16_split_layout")
def win16(spark, sf):
    return sq.split_layout(lines(spark, sf)).select("stream_id", "seq", "part", "new_start", "new_end", "text", "too_short")


@query("win17_interpolate_starts", with_(LN, """a AS (SELECT *, CASE WHEN seq % 4 = 2 THEN start_ms + seq % 3 * 900 END AS an FROM ln),
b AS (SELECT stream_id, seq, CAST(an AS DOUBLE) AS an, max(CASE WHEN an IS NOT NULL THEN seq END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ai,
  min(CASE WHEN an IS NOT NULL THEN seq END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi, count(*) OVER (PARTITION BY stream_id) AS n FROM a),
c AS (SELECT b.*, x.an AS t0, y.an AS t1 FROM b LEFT JOIN b x ON x.stream_id = b.stream_id AND x.seq = b.ai LEFT JOIN b y ON y.stream_id = b.stream_id AND y.seq = b.bi),
d AS (SELECT *, CASE WHEN ai IS NULL AND bi IS NULL THEN NULL WHEN ai IS NULL THEN 0 + greatest(100.0, t1 - 0) * seq / bi
   WHEN bi IS NULL THEN t0 + greatest(100.0, 9000000.0 - t0) * (seq - ai) / (n - ai + 1) WHEN ai = bi THEN t0
   ELSE t0 + (t1 - t0) * (seq - ai) / (bi - ai) END AS raw FROM c)""") + """
SELECT stream_id, seq, round(max(raw - seq * 50) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + seq * 50, 3) AS new_start FROM d""")
def win17(spark, sf):
    df = lines(spark, sf).withColumn("anchor", F.when(F.col("seq") % 4 == 2, F.col("start_ms") + F.col("seq") % 3 * 900))
    out = sq.interpolate_starts(df, LINE_ORDER, "anchor", L(0.0), L(9_000_000.0))
    return out.select("stream_id", "seq", rounded("new_start", 3).alias("new_start"))


WORDS = """wd AS (SELECT stream_id, turn AS interval, turn * 100000 + pos AS seq, turn * 600000 + pos * 300 AS start_ms, turn * 600000 + pos * 300 + 250 AS end_ms, w || ' ' AS text FROM (
  SELECT conv_id AS stream_id, turn, CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS BIGINT) AS pos, unnest(string_split(text, ' ')) AS w FROM conversations))"""


@query("win18_group_items", rec(WORDS, f"""nb AS (SELECT *, {sql_width('text')} AS wid, regexp_matches(rtrim(text), '[.!?]$') AS stop,
   row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS rn FROM wd)""", """r AS (
  SELECT stream_id, rn, interval, 1 AS g, start_ms AS f, CAST(wid AS DOUBLE) AS tw, (wid >= 20 OR end_ms - start_ms >= 4500 OR (stop AND end_ms - start_ms >= 1200)) AS closed FROM nb WHERE rn = 1
  UNION ALL
  SELECT stream_id, rn, interval, g, f, tw, (tw >= 20 OR end_ms - f >= 4500 OR (stop AND end_ms - f >= 1200)) FROM (
    SELECT n.stream_id, n.rn, n.interval, n.end_ms, n.stop, r.g + CASE WHEN r.closed OR r.interval <> n.interval THEN 1 ELSE 0 END AS g,
      CASE WHEN r.closed OR r.interval <> n.interval THEN n.start_ms ELSE r.f END AS f, CASE WHEN r.closed OR r.interval <> n.interval THEN CAST(n.wid AS DOUBLE) ELSE r.tw + n.wid END AS tw
    FROM r JOIN nb n ON n.stream_id = r.stream_id AND n.rn = r.rn + 1))""") + """
SELECT r.stream_id, CAST(g AS BIGINT) AS segment, arg_min(n.start_ms, n.rn) AS start_ms, arg_max(n.end_ms, n.rn) AS end_ms, string_agg(n.text, '' ORDER BY n.rn) AS text, count(*) AS items
FROM r JOIN nb n ON n.stream_id = r.stream_id AND n.rn = r.rn GROUP BY r.stream_id, g HAVING trim(string_agg(n.text, '' ORDER BY n.rn)) <> ''""")
def win18(spark, sf):
    words = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("interval"), F.posexplode(F.split("text", " ")).alias("pos", "w")
    )
    words = words.select(
        "stream_id", "interval", (F.col("interval") * 100_000 + F.col("pos")).alias("seq"), (F.col("interval") * 600_000 + F.col("pos") * 300).alias("start_ms"),
        (F.col("interval") * 600_000 + F.col("pos") * 300 + 250).alias("end_ms"), F.concat("w", L(" ")).alias("text"),
    )
    out = sq.group_items(words, Order(by=("seq",)), 20.0)
    return out.select("stream_id", "segment", "start_ms", "end_ms", "text", "items")


@query("win19_neighbour_context", with_(TN) + """
SELECT stream_id, seq, coalesce(array_to_string(list(speaker || ':' || CAST(seq AS VARCHAR)) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS before,
  coalesce(array_to_string(list(speaker || ':' || CAST(seq AS VARCHAR)) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS after FROM tn""")
def win19(spark, sf):
    tn, order = chunked(turns(spark, sf), TURN_ORDER, 1000)
    tag = F.concat_ws(":", "speaker", F.col("seq").cast("string"))
    out = context(tn, order, tag, 2, 2, block=3)
    return out.select("stream_id", "seq", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("win20_partition_issues", with_(TN) + """,
g AS (SELECT stream_id, seq // 3 AS group_no, min(seq) AS a, max(seq) AS b, arg_min(start_ms, seq) AS s, arg_max(end_ms, seq) AS e FROM tn GROUP BY stream_id, seq // 3),
m AS (SELECT stream_id, group_no, seq FROM (SELECT *, seq // 3 AS group_no FROM tn) WHERE NOT (stream_id % 5 = 2 AND seq = 0)
  UNION ALL SELECT stream_id, group_no, 0 FROM g WHERE stream_id % 5 = 3 AND group_no = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY group_no, CASE WHEN seq < group_no * 3 THEN 1000000 ELSE seq END) AS gp, count(*) OVER (PARTITION BY stream_id, seq) AS tm FROM m),
t AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS tp FROM tn),
j AS (SELECT coalesce(l.stream_id, t.stream_id) AS stream_id, l.group_no, coalesce(l.seq, t.seq) AS seq,
   CASE WHEN tp IS NULL THEN 'unknown_row' WHEN gp IS NULL THEN 'missing_row' WHEN tm > 1 THEN 'repeated_row' WHEN gp <> tp THEN 'out_of_order' END AS code
   FROM l FULL JOIN t ON l.stream_id = t.stream_id AND l.seq = t.seq),
ed AS (SELECT l.stream_id, l.group_no, arg_min(t.start_ms, gp) AS s, arg_max(t.end_ms, gp) AS e FROM l JOIN t ON l.stream_id = t.stream_id AND l.seq = t.seq GROUP BY ALL)
SELECT stream_id, group_no, seq, code FROM j WHERE code IS NOT NULL
UNION ALL
SELECT g.stream_id, g.group_no, NULL, 'edge_mismatch' FROM g JOIN ed ON g.stream_id = ed.stream_id AND g.group_no = ed.group_no
WHERE g.s <> ed.s OR g.e + CASE WHEN g.stream_id % 5 = 1 AND g.group_no = 0 THEN 1 ELSE 0 END <> ed.e""")
def win20(spark, sf):
    tn = turns(spark, sf)
    group = F.floor(F.col("seq") / 3)
    g = tn.groupBy("stream_id", group.alias("group_no")).agg(
        F.array_sort(F.collect_list("seq")).alias("members"), F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms")
    )
    fifth = F.col("stream_id") % 5
    g = g.withColumn(
        "members",
        F.when((fifth == 2) & (F.col("group_no") == 0), F.filter("members", lambda x: x != 0))
        .when((fifth == 3) & (F.col("group_no") == 1), F.concat("members", F.array(L(0).cast("long"))))
        .otherwise(F.col("members")),
    ).withColumn("end_ms", F.col("end_ms") + F.when((fifth == 1) & (F.col("group_no") == 0), 1).otherwise(0))
    return sq.partition_issues(g, tn, TURN_ORDER)


@query("win21_collapse_repeats", with_(LN, """a AS (SELECT *, length(text) % 2 = 0 AS ok FROM ln),
b AS (SELECT *, lag(text) OVER w AS pt, lag(end_ms) OVER w AS pe, lag(ok) OVER w AS pok FROM a WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
c AS (SELECT *, sum(CASE WHEN coalesce(ok AND pok AND text = pt AND start_ms <= pe + 900, false) THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM b),
d AS (SELECT stream_id, g, min(seq) AS seq, arg_min(start_ms, seq) AS s, arg_max(end_ms, seq) AS e, count(*) AS members FROM c GROUP BY stream_id, g)""") + """
SELECT stream_id, seq, s AS start_ms, CASE WHEN members > 1 THEN least(e, s + 7000) ELSE e END AS end_ms, members FROM d""")
def win21(spark, sf):
    df = lines(spark, sf).withColumn("source_key", F.col("stream_id").cast("string"))
    out = sq.collapse_repeats(df, LINE_ORDER, F.length("text") % 2 == 0, 900, 7000)
    return out.select("stream_id", "seq", "start_ms", "end_ms", "members")


def order_rows(spark, sf):
    """Order lines as cues of an order, in file order of part, supplier and price."""
    ship = F.datediff("l_shipdate", L("1992-01-01")).cast("long")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").cast("long").alias("seq"), ship.alias("start_ms"),
        (ship + F.col("l_quantity").cast("long") - 10).alias("end_ms"), "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"),
    )


OL = """ol AS (SELECT l_orderkey AS stream_id, CAST(l_linenumber AS BIGINT) AS seq, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS start_ms,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) - 10 AS BIGINT) AS end_ms, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem)"""
FILE_ORDER = Order(by=("seq", "l_partkey", "l_suppkey", "price"))


@query("aud2_structure_issues", with_(OL, """rf AS (SELECT * FROM ol WHERE l_partkey % 2 = 0),
ra AS (SELECT *, max(end_ms) OVER (PARTITION BY stream_id ORDER BY seq, l_partkey, l_suppkey, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rf),
kn AS (SELECT DISTINCT stream_id, seq FROM ra WHERE start_ms < reach),
a AS (SELECT *, max(end_ms) OVER w AS reach, row_number() OVER (PARTITION BY stream_id ORDER BY seq, l_partkey, l_suppkey, price) AS pos, count(*) OVER (PARTITION BY stream_id, seq) AS tm
  FROM ol WINDOW w AS (PARTITION BY stream_id ORDER BY seq, l_partkey, l_suppkey, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""") + """
SELECT stream_id, seq, pos AS row_no, 'duplicate_number' AS code, 'error' AS severity FROM a WHERE tm > 1
UNION ALL SELECT stream_id, seq, pos, 'number_not_in_sequence', 'error' FROM a WHERE seq <> pos
UNION ALL SELECT stream_id, seq, pos, 'reversed_time', 'error' FROM a WHERE end_ms < start_ms
UNION ALL SELECT a.stream_id, a.seq, pos, 'overlap', CASE WHEN k.seq IS NULL THEN 'error' ELSE 'warning' END FROM a LEFT JOIN kn k ON k.stream_id = a.stream_id AND k.seq = a.seq WHERE start_ms < reach""")
def aud2(spark, sf):
    rows = order_rows(spark, sf)
    return sq.structure_issues(rows, FILE_ORDER, rows.where("l_partkey % 2 = 0"))


@query("aud3_cue_validity", with_(OL, """a AS (SELECT *, max(end_ms) OVER (PARTITION BY stream_id ORDER BY seq, l_partkey, l_suppkey, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
  row_number() OVER (PARTITION BY stream_id ORDER BY seq, l_partkey, l_suppkey, price) AS pos FROM ol)""") + """
SELECT stream_id, count(*) AS cues, count(*) FILTER (seq <> pos) AS id_breaks, count(*) FILTER (end_ms <= start_ms) AS non_positive,
 count(*) FILTER (start_ms < pe - 1) AS overlaps, count(*) FILTER (price % 10 = 0) AS empty_text, CAST(0 AS BIGINT) AS non_finite,
 count(*) FILTER (seq <> pos) + count(*) FILTER (end_ms <= start_ms) + count(*) FILTER (start_ms < pe - 1) + count(*) FILTER (price % 10 = 0) = 0 AS valid FROM a GROUP BY stream_id""")
def aud3(spark, sf):
    rows = order_rows(spark, sf).withColumn("text", F.when(F.col("price") % 10 == 0, " ").otherwise("x"))
    return sq.cue_validity(rows, FILE_ORDER)


def sql_runaways(src: str) -> str:
    """``runaway``: rows of ``src`` where 1-3 characters repeat five times (RE2 has no back-references)."""
    ch = f"""chr_ AS (SELECT stream_id, seq, unnest(string_split({sql_compact('text')}, '')) AS c,
  generate_subscripts(string_split({sql_compact('text')}, ''), 1) AS pos FROM {src} WHERE length(text) > 0)"""
    found = " UNION ".join(
        f"""SELECT DISTINCT stream_id, seq FROM (SELECT stream_id, seq, pos - row_number() OVER (PARTITION BY stream_id, seq ORDER BY pos) AS g
  FROM (SELECT *, lag(c, {n}) OVER (PARTITION BY stream_id, seq ORDER BY pos) AS p FROM chr_) WHERE c = p) GROUP BY stream_id, seq, g HAVING count(*) >= {4 * n}"""
        for n in (1, 2, 3)
    )
    return ch + ",\nrunaway AS (" + found + ")"


@query("aud4_transcript_warnings", with_(LN, f"""a AS (SELECT *, {sql_squeeze('text')} AS key FROM ln),
b AS (SELECT *, last_value(CASE WHEN key <> '' THEN key END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt,
  lag(start_ms) OVER (PARTITION BY stream_id, key ORDER BY seq) AS ps FROM a)""", sql_runaways("ln")) + """
SELECT stream_id, seq, array_to_string(list_sort(list_filter([
  CASE WHEN key = '' THEN 'empty_text' END, CASE WHEN length(text) % 37 > 26 THEN 'high_compression_ratio' END, CASE WHEN length(text) % 13 > 10 THEN 'low_average_logprob' END,
  CASE WHEN seq % 10 >= 7 AND key <> '' THEN 'speech_in_no_speech_region' END, CASE WHEN EXISTS (SELECT 1 FROM runaway r WHERE r.stream_id = b.stream_id AND r.seq = b.seq) THEN 'possible_runaway_repetition' END,
  CASE WHEN length(key) >= 4 AND key = pt THEN 'exact_adjacent_repeat' END, CASE WHEN length(key) >= 4 AND start_ms - ps >= 10000 THEN 'periodic_repeat' END], lambda x: x IS NOT NULL)), ',') AS warnings FROM b""")
def aud4(spark, sf):
    df = lines(spark, sf).withColumns(
        {
            "compression_ratio": F.length("text") % 37 / 10.0,
            "avg_logprob": -(F.length("text") % 13) / 10.0,
            "no_speech_prob": F.col("seq") % 10 / 10.0,
        }
    )
    out = sq.transcript_warnings(df, LINE_ORDER)
    return out.select("stream_id", "seq", F.array_join("warnings", ",").alias("warnings"))
