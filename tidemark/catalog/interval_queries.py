"""Interval joins and windows on the events table (one stream per user)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.frames import CHUNK, DAY, EV, EV_ORDER, HOUR, MONTH, chunked_events, events, sql_jaccard, sql_squeeze, with_
from tidemark.catalog.registry import query
from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded
from tidemark.operators import intervals as iv
from tidemark.operators.ordered import Order

BUCKET = 8 * HOUR


def family(df, *names):
    return df.where(F.col("family").isin(*names))


# two "engines" that look at the same users: clicks/views against the others
LEFT, RIGHT = ("click", "view"), ("purchase", "error", "signup")
SIDES = """a AS (SELECT * FROM ev WHERE family IN ('click', 'view')),
b AS (SELECT * FROM ev WHERE family IN ('purchase', 'error', 'signup'))"""
PAIRS = """p AS (
  SELECT a.stream_id, a.seq, a.start_ms, a.end_ms, a.text, a.family, b.seq AS r_seq, b.start_ms AS r_start_ms,
         b.end_ms AS r_end_ms, b.text AS r_text, b.family AS r_family,
         least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms
  FROM a JOIN b ON a.stream_id = b.stream_id AND a.start_ms < b.end_ms AND a.end_ms > b.start_ms)"""


def sides(spark, sf):
    ev = events(spark, sf)
    return family(ev, *LEFT), family(ev, *RIGHT)


@query("join1_best_overlap", with_(EV, SIDES, PAIRS) + """
SELECT a.stream_id, a.seq, m.r_seq AS match_seq, coalesce(m.overlap_ms, 0) AS overlap_ms,
       abs(a.start_ms - m.r_start_ms) AS distance_ms,
       CASE WHEN m.r_seq IS NULL THEN 'unresolved'
            WHEN m.overlap_ms * 10 >= greatest(a.end_ms - a.start_ms, 1) * 8 THEN 'high'
            WHEN m.overlap_ms * 100 >= greatest(a.end_ms - a.start_ms, 1) * 35 THEN 'medium' ELSE 'low' END AS confidence
FROM a LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY stream_id, seq
    ORDER BY overlap_ms DESC, abs(start_ms - r_start_ms), r_start_ms, r_end_ms, r_seq) AS rn
  FROM p WHERE overlap_ms > 0) m ON a.stream_id = m.stream_id AND a.seq = m.seq AND m.rn = 1""")
def join1(spark, sf):
    a, b = sides(spark, sf)
    return iv.best_overlap(a, b, BUCKET).select("stream_id", "seq", "match_seq", "overlap_ms", "distance_ms", "confidence")


@query("join2_overlap_evidence", with_(EV, SIDES, PAIRS) + """,
u AS (SELECT stream_id, seq, r_start_ms, r_end_ms, r_text, min(r_seq) AS r_seq, arg_min(r_family, r_seq) AS r_family
      FROM p GROUP BY ALL)
SELECT a.stream_id, a.seq,
  coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT r_seq AS x FROM u WHERE u.stream_id = a.stream_id AND u.seq = a.seq)), '') AS refs,
  coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT r_family AS x FROM u WHERE u.stream_id = a.stream_id AND u.seq = a.seq)), '') AS families,
  CAST((SELECT count(*) FROM u WHERE u.stream_id = a.stream_id AND u.seq = a.seq) AS BIGINT) AS witnesses,
  CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.stream_id = a.stream_id AND u.seq = a.seq) THEN 'attached' ELSE 'no_evidence' END AS evidence_status
FROM a""".replace(",\nu AS", ",\nu AS"))
def join2(spark, sf):
    a, b = sides(spark, sf)
    out = iv.overlap_evidence(a, b, BUCKET)
    return out.select(
        "stream_id", "seq", F.array_join(F.col("evidence_refs").cast("array<string>"), ",").alias("refs"),
        F.array_join("families", ",").alias("families"), F.size("witnesses").cast("long").alias("witnesses"), "evidence_status",
    )


@query("join3_attribution", with_(EV, SIDES, PAIRS) + """,
q AS (SELECT *, (overlap_ms * 100 >= (end_ms - start_ms) * 50 AND overlap_ms * 100 >= greatest(r_end_ms - r_start_ms, 1) * 20
       AND r_start_ms * 2 <= start_ms + end_ms AND start_ms + end_ms < r_end_ms * 2) AS fits FROM p),
n AS (SELECT *, count(*) FILTER (fits) OVER (PARTITION BY stream_id, seq) AS c FROM q)
SELECT stream_id, seq, r_seq, overlap_ms,
  CASE WHEN c = 1 AND fits THEN CASE WHEN start_ms < r_start_ms OR end_ms > r_end_ms THEN 'primary-expanded' ELSE 'primary' END
       ELSE 'multi-block-context' END AS attribution,
  (c = 1 AND fits AND NOT (start_ms < r_start_ms OR end_ms > r_end_ms)) AS block_aligned
FROM n""")
def join3(spark, sf):
    a, b = sides(spark, sf)
    out = iv.attribute_segments(a, b, BUCKET)
    return out.select("stream_id", "seq", "r_seq", "overlap_ms", "attribution", "block_aligned")


@query("join4_uncovered_reference", with_(EV, SIDES) + """
SELECT stream_id, seq, start_ms, end_ms FROM a WHERE NOT EXISTS (
  SELECT 1 FROM b WHERE a.stream_id = b.stream_id
   AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 600000)""")
def join4(spark, sf):
    a, b = sides(spark, sf)
    return iv.uncovered(a, b, BUCKET, 600_000).select("stream_id", "seq", "start_ms", "end_ms")


@query("join5_disagreements", with_(EV, SIDES, PAIRS) + f""",
s AS (SELECT *, {sql_jaccard('text', 'r_text')} AS sim FROM p WHERE overlap_ms >= 60000)
SELECT stream_id, seq, round(max(sim), 6) AS best_similarity, count(*) AS rivals,
  array_to_string(list_slice(list(r_text ORDER BY r_start_ms, r_end_ms, r_seq), 1, 3), '|') AS alternatives
FROM s GROUP BY stream_id, seq HAVING max(sim) < 0.15""")
def join5(spark, sf):
    a, b = sides(spark, sf)
    out = iv.disagreements(a, b, BUCKET, 60_000)
    return out.select(
        "stream_id", "seq", rounded("best_similarity", 6).alias("best_similarity"), "rivals",
        F.array_join("alternatives", "|").alias("alternatives"),
    )


@query("join5_disagreements_of_fit_rivals", with_(EV, SIDES, PAIRS) + f""",
fit AS (SELECT * FROM p JOIN (SELECT seq AS r_seq, k AS r_k FROM ev) USING (r_seq) WHERE overlap_ms >= 60000 AND r_k % 4 <> 0 AND r_end_ms - r_start_ms <= {4 * HOUR} AND r_end_ms - r_start_ms + 2 - r_k % 3 * 1000000 > 1),
s AS (SELECT *, {sql_jaccard('text', 'r_text')} AS sim FROM fit)
SELECT stream_id, seq, round(max(sim), 6) AS best_similarity, count(*) AS rivals,
  array_to_string(list_slice(list(r_text ORDER BY r_start_ms, r_end_ms, r_seq), 1, 3), '|') AS alternatives
FROM s GROUP BY stream_id, seq HAVING max(sim) < 0.15""")
def join5b(spark, sf):
    """Rivals without an alignment, with an empty one, or too long don't count."""
    a, b = sides(spark, sf)
    span = F.col("end_ms") - F.col("start_ms") + 2 - F.col("k") % 3 * 1_000_000
    b = b.withColumn("span_ms", F.when(F.col("k") % 4 != 0, span))
    out = iv.disagreements(a, b, BUCKET, 60_000, eligible=iv.recoverable(4 * HOUR))
    return out.select("stream_id", "seq", rounded("best_similarity", 6).alias("best_similarity"), "rivals", F.array_join("alternatives", "|").alias("alternatives"))


def durations(ev):
    return ev.select("stream_id").distinct().withColumn("duration_ms", F.lit(MONTH).cast("long"))


GAPS = f"""cur AS (
  SELECT stream_id, least({MONTH}, greatest(0, start_ms)) AS s, least({MONTH}, end_ms) AS e, start_ms, end_ms, seq FROM %s),
run AS (
  SELECT stream_id, s AS gap_end, greatest(coalesce(max(e) OVER (PARTITION BY stream_id ORDER BY s, e, seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS gap_start FROM cur
  UNION ALL
  SELECT stream_id, {MONTH}, greatest(0, least({MONTH}, max(end_ms))) FROM %s GROUP BY stream_id),
gaps AS (SELECT stream_id, CAST(gap_start AS BIGINT) AS gap_start, CAST(gap_end AS BIGINT) AS gap_end FROM run WHERE gap_end - gap_start >= %d)"""


@query("win4_coverage_gaps", with_(EV, GAPS % ("ev", "ev", 6 * HOUR)) + "SELECT * FROM gaps")
def win4(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    return iv.coverage_gaps(ev, durations(ev), 6 * HOUR, order).select(
        "stream_id", F.col("gap_start").cast("long").alias("gap_start"), F.col("gap_end").cast("long").alias("gap_end")
    )


MERGE = """reach AS (
  SELECT *, max(end_ms) OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM %s),
isl AS (
  SELECT *, sum(CASE WHEN r IS NULL OR start_ms > r + %d THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, seq
    ROWS UNBOUNDED PRECEDING) AS island FROM reach)"""


@query("win3_merge_intervals", with_(EV, MERGE % ("ev", HOUR)) + """
SELECT stream_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members,
       array_to_string(list_sort(list(DISTINCT family)), ',') AS reasons
FROM isl GROUP BY stream_id, island""")
def win3(spark, sf):
    ev, order = chunked_events(events(spark, sf).withColumn("reasons", F.array("family")))
    out = iv.merge_intervals(ev, order, HOUR)
    return out.select("stream_id", "start_ms", "end_ms", "members", F.array_join("reasons", ",").alias("reasons"))


CENTRE = f"""CAST(least(greatest(0, floor((start_ms + end_ms) / 2) - {HOUR}), {MONTH} - {2 * HOUR}) AS BIGINT)"""


@query("win8_fixed_windows", with_(EV) + f"""
SELECT seq, {CENTRE} AS clip_start, {CENTRE} + {2 * HOUR} AS clip_end,
  CAST(CASE WHEN least({MONTH}, end_ms) > greatest(0, start_ms) THEN greatest(0, least({MONTH}, greatest(0, greatest(0, start_ms) - 120000) + 480000) - 480000) END AS BIGINT) AS focus_start,
  CAST(CASE WHEN least({MONTH}, end_ms) > greatest(0, start_ms) THEN least({MONTH}, greatest(0, greatest(0, start_ms) - 120000) + 480000) END AS BIGINT) AS focus_end
FROM ev""")
def win8(spark, sf):
    ev = events(spark, sf)
    limit = F.lit(MONTH).cast("long")
    out = iv.centred_windows(ev, limit, 2 * HOUR)
    out = out.withColumnsRenamed({"clip_start": "c0", "clip_end": "c1"})
    focus = iv.focused_windows(out, limit, 480_000, 120_000)
    void = out.where(~(F.least(limit, F.col("end_ms")) > F.greatest(F.lit(0), F.col("start_ms"))))
    focus = focus.unionByName(void, allowMissingColumns=True)
    return focus.select(
        "seq", F.col("c0").cast("long").alias("clip_start"), F.col("c1").cast("long").alias("clip_end"),
        F.col("clip_start").cast("long").alias("focus_start"), F.col("clip_end").cast("long").alias("focus_end"),
    )


@query("win9_sliding_windows", with_(EV, MERGE % ("ev", HOUR)) + f""",
mg AS (SELECT stream_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM isl GROUP BY stream_id, island),
parts AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((end_ms - start_ms - 600000) / {2 * HOUR - 600000}) AS BIGINT)))) AS part FROM mg),
wn AS (SELECT stream_id, part, start_ms + part * {2 * HOUR - 600000} AS window_start,
       least(end_ms, start_ms + part * {2 * HOUR - 600000} + {2 * HOUR}) AS window_end FROM parts)
SELECT w.stream_id, w.window_start, w.window_end, count(*) AS n_rows, min(e.seq) AS first_row, max(e.seq) AS last_row
FROM wn w JOIN ev e ON w.stream_id = e.stream_id AND w.window_start < e.end_ms AND w.window_end > e.start_ms
GROUP BY ALL""")
def win9(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    merged = iv.merge_intervals(ev, order, HOUR, reasons=None)
    wins = iv.sliding_windows(merged, 2 * HOUR, 600_000).select(
        "stream_id", F.col("window_start").alias("start_ms"), F.col("window_end").alias("end_ms")
    )
    rows = iv.interval_pairs(wins, ev.select("stream_id", "seq", "start_ms", "end_ms"), BUCKET)
    return rows.groupBy("stream_id", F.col("start_ms").alias("window_start"), F.col("end_ms").alias("window_end")).agg(
        F.count("*").alias("n_rows"), F.min("r_seq").alias("first_row"), F.max("r_seq").alias("last_row")
    )


def spaced_sql(src: str, k: int, out: str) -> str:
    picks = ", ".join(f"CAST(round_even(CAST({i} AS DOUBLE) * (n - 1) / {k - 1}, 0) AS BIGINT)" for i in range(k))
    return f"""{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, seq) - 1 AS pos,
      count(*) OVER (PARTITION BY stream_id) AS n FROM {src}) WHERE n <= {k} OR list_contains([{picks}], pos))"""


@query("smp1_evenly_spaced", with_(EV, spaced_sql("ev", 7, "sp")) + "SELECT stream_id, seq FROM sp")
def smp1(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    return iv.spaced(ev, order, 7).select("stream_id", "seq")


def _clip(src: str, rank: int, reason: str) -> str:
    return f"SELECT stream_id, {rank} AS rnk, {CENTRE} AS start_ms, {CENTRE} + {2 * HOUR} AS end_ms, '{reason}' AS reason FROM {src}"


@query("win11_audit_plan", with_(
    EV, SIDES,
    "warn AS (SELECT * FROM a WHERE cents > 12000)", spaced_sql("warn", 4, "w1"),
    """miss AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.stream_id = b.stream_id
       AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 200))""", spaced_sql("miss", 4, "w2"),
    GAPS % ("a", "a", 12 * HOUR),
    "g AS (SELECT stream_id, gap_start AS start_ms, gap_end AS end_ms, gap_start AS seq FROM gaps)", spaced_sql("g", 4, "w3"),
    f"""ud AS (SELECT DISTINCT stream_id FROM a),
w4 AS (SELECT stream_id, floor({MONTH} * (i * 2 + 1) / 8) AS start_ms, floor({MONTH} * (i * 2 + 1) / 8) AS end_ms FROM ud, range(4) r(i))""",
    f"""al AS ({_clip('w1', 1, 'warning')} UNION ALL {_clip('w2', 2, 'uncovered')} UNION ALL {_clip('w3', 3, 'gap')} UNION ALL {_clip('w4', 4, 'audit')}),
pl AS (SELECT * FROM (SELECT al.*, row_number() OVER (PARTITION BY al.stream_id ORDER BY rnk, start_ms, end_ms) AS seq FROM al SEMI JOIN ud USING (stream_id)) WHERE seq <= 16)""",
    MERGE % ("pl", 150)) + """
SELECT stream_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members,
   array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM isl GROUP BY stream_id, island""")
def win11(spark, sf):
    a, b = sides(spark, sf)
    a, order = chunked_events(a)
    plan = iv.audit_plan(a, b, durations(a), F.col("cents") > 12_000, 2 * HOUR, BUCKET, 12 * HOUR, order=order)
    return plan.select(
        "stream_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"),
        "members", F.array_join("reasons", ",").alias("reasons"),
    )


NEAR = """SELECT a.stream_id, a.seq, b.seq AS match_seq, row_number() OVER (PARTITION BY a.stream_id, a.seq
  ORDER BY abs((a.start_ms + a.end_ms) - (b.start_ms + b.end_ms)), b.start_ms + b.end_ms, b.seq DESC) AS rn
FROM a JOIN b ON a.stream_id = b.stream_id"""


@query("join8_overlap_or_nearest", with_(EV, SIDES, PAIRS) + f""",
ov AS (SELECT *, row_number() OVER (PARTITION BY stream_id, seq ORDER BY overlap_ms DESC, abs(start_ms - r_start_ms), r_start_ms, r_end_ms, r_seq) AS rn FROM p WHERE overlap_ms > 0),
nr AS ({NEAR})
SELECT a.stream_id, a.seq, coalesce(ov.r_seq, nr.match_seq) AS match_seq,
  CASE WHEN ov.r_seq IS NOT NULL THEN 'overlap' WHEN nr.match_seq IS NOT NULL THEN 'nearest' ELSE 'none' END AS how
FROM a LEFT JOIN ov ON a.stream_id = ov.stream_id AND a.seq = ov.seq AND ov.rn = 1
LEFT JOIN nr ON a.stream_id = nr.stream_id AND a.seq = nr.seq AND nr.rn = 1""")
def join8(spark, sf):
    a, b = sides(spark, sf)
    return iv.overlap_or_nearest(a, b, BUCKET, chunk_ms=CHUNK)


OFFSETS = f"""tb AS (SELECT stream_id, lo, CASE WHEN stream_id % 17 = 3 AND lo = 0 THEN hi - 1 ELSE hi END AS hi, off FROM (
  SELECT stream_id, i * {10 * DAY} AS lo, (i + 1) * {10 * DAY} AS hi, (stream_id % 7 - 3) * 1000 + i * 500 AS off
  FROM (SELECT DISTINCT stream_id FROM ev), range(3) r(i)) WHERE stream_id % 13 <> 5)"""


MAPPED = f"""
h AS (SELECT stream_id, bool_or(hi <= lo OR (nx IS NOT NULL AND nx <> hi)) AS broken FROM
      (SELECT *, lead(lo) OVER (PARTITION BY stream_id ORDER BY lo) AS nx FROM tb) GROUP BY stream_id),
m AS (SELECT e.stream_id, e.seq, h.broken, h.stream_id IS NULL AS missing,
  e.start_ms + (SELECT off FROM tb WHERE tb.stream_id = e.stream_id AND lo <= e.start_ms AND (e.start_ms < hi OR (lo = {20 * DAY} AND e.start_ms = hi))) AS ms,
  e.end_ms + (SELECT off FROM tb WHERE tb.stream_id = e.stream_id AND lo <= e.end_ms AND (e.end_ms < hi OR (lo = {20 * DAY} AND e.end_ms = hi))) AS me
  FROM ev e LEFT JOIN h ON e.stream_id = h.stream_id),
r AS (SELECT *, list_filter([CASE WHEN missing THEN 'no_table' END, CASE WHEN broken THEN 'table_not_contiguous' END,
   CASE WHEN NOT missing AND (ms IS NULL OR me IS NULL) THEN 'outside_table' END, CASE WHEN me <= ms THEN 'mapped_range_reversed' END], lambda x: x IS NOT NULL) AS rs FROM m)"""


def offset_table(ev):
    return (
        ev.select("stream_id").distinct().where("stream_id % 13 <> 5")
        .withColumn("i", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
        .select(
            "stream_id", (F.col("i") * 10 * DAY).alias("lo"), ((F.col("i") + 1) * 10 * DAY).alias("hi"),
            ((F.col("stream_id") % 7 - 3) * 1000 + F.col("i") * 500).alias("offset_ms"),
        )
        .withColumn("hi", F.when((F.col("stream_id") % 17 == 3) & (F.col("lo") == 0), F.col("hi") - 1).otherwise(F.col("hi")))
    )


@query("join9_offset_lookup", with_(EV, OFFSETS, MAPPED.strip()) + """
SELECT stream_id, seq, CASE WHEN len(rs) = 0 THEN ms END AS mapped_start, CASE WHEN len(rs) = 0 THEN me END AS mapped_end,
  CASE WHEN len(rs) = 0 THEN 'mapped' ELSE 'unresolved' END AS status, array_to_string(rs, ',') AS reasons FROM r""")
def join9(spark, sf):
    ev = events(spark, sf)
    out = iv.map_through_offsets(ev, offset_table(ev), chunk_ms=CHUNK)
    return out.select("stream_id", "seq", "mapped_start", "mapped_end", "status", F.array_join("reasons", ",").alias("reasons"))


@query("join9_stream_gate", with_(EV, OFFSETS, MAPPED.strip()) + f""",
ok AS (SELECT stream_id, len(rs) = 0 AS mapped, ms, me, CASE WHEN stream_id % 3 <> 0 THEN {20 * DAY} + stream_id % 12 * {DAY} END AS dur FROM r),
g AS (SELECT stream_id, count(*) AS rows, count(*) FILTER (mapped AND ms >= 0 AND NOT coalesce(me > dur + 2000, false)) AS mapped_rows,
  count(*) FILTER (NOT mapped) AS x0, count(*) FILTER (mapped AND ms < 0) AS x1, count(*) FILTER (mapped AND me > dur + 2000) AS x2 FROM ok GROUP BY stream_id),
an AS (SELECT DISTINCT stream_id, i, i * {DAY}::BIGINT AS t, i * {DAY}::BIGINT + (stream_id % 7 - 3) * 1000 + stream_id % 5 * 1000 AS media FROM ev, (VALUES (1), (15), (30)) v(i)),
bad AS (SELECT a.stream_id, count(*) FILTER (NOT coalesce(abs(t + off - media) <= 2000, false)) AS x3
  FROM an a LEFT JOIN (SELECT *, hi = max(hi) OVER (PARTITION BY stream_id) AS last FROM tb) b ON a.stream_id = b.stream_id AND t >= lo AND (t < hi OR (last AND t = hi)) GROUP BY a.stream_id),
q AS (SELECT stream_id, rows, mapped_rows, list_filter([CASE WHEN x0 > 0 THEN 'unmapped_rows' END, CASE WHEN x1 > 0 THEN 'mapped_start_negative' END, CASE WHEN x2 > 0 THEN 'mapped_end_past_media' END,
  CASE WHEN x3 > 0 THEN 'anchor_off_map' END], lambda x: x IS NOT NULL) AS rs FROM g LEFT JOIN bad USING (stream_id))
SELECT stream_id, rows, mapped_rows, array_to_string(rs, ',') AS reasons, CASE WHEN len(rs) = 0 THEN 'resolved' ELSE 'unresolved' END AS status FROM q""")
def join9b(spark, sf):
    ev = events(spark, sf)
    table_ = offset_table(ev)
    streams = ev.select("stream_id").distinct()
    media = streams.where("stream_id % 3 <> 0").withColumn("duration_ms", 20 * DAY + F.col("stream_id") % 12 * DAY)
    day = F.col("i").cast("long") * DAY
    anchors = streams.withColumn("i", F.explode(F.array(*map(F.lit, (1, 15, 30))))).select(
        "stream_id", day.alias("at_ms"), (day + (F.col("stream_id") % 7 - 3) * 1000 + F.col("stream_id") % 5 * 1000).alias("media_ms"))
    out = iv.offset_gate(iv.map_through_offsets(ev, table_, chunk_ms=CHUNK), media, anchors, table_, 2000)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("join10_overlap_harvest", with_(EV, SIDES, PAIRS) + """,
k AS (SELECT *, regexp_replace(lower(r_text), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM p
  WHERE r_family <> 'error' AND (overlap_ms * 100 >= greatest(end_ms - start_ms, 1) * 50 OR overlap_ms * 100 >= greatest(r_end_ms - r_start_ms, 1) * 50)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, seq, key ORDER BY r_start_ms, r_end_ms, r_seq) AS rn FROM k) WHERE rn = 1)
SELECT stream_id, seq, string_agg(r_text, ' ' ORDER BY r_start_ms, r_end_ms, r_seq) AS harvest,
  string_agg(CAST(r_seq AS VARCHAR), ',' ORDER BY r_start_ms, r_end_ms, r_seq) AS source_ids FROM f GROUP BY stream_id, seq""")
def join10(spark, sf):
    a, b = sides(spark, sf)
    out = iv.harvest_text(a, b, BUCKET, banned=F.col("family") == "error")
    return out.select("stream_id", "seq", "harvest", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"))


@query("join11_cut_and_recover", with_(EV) + """,
ns AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, seq) AS seq, start_ms, end_ms, text, family FROM ev WHERE family <> 'signup'),
sr AS (SELECT * FROM ev WHERE family = 'signup'),
bad AS (SELECT *, seq - row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS g FROM ns WHERE family = 'error'),
runs AS (SELECT stream_id, g, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM bad GROUP BY stream_id, g),
fil AS (SELECT r.stream_id, r.g, s.seq, greatest(r.start_ms, s.start_ms) AS start_ms, least(r.end_ms, s.end_ms) AS end_ms, s.text
  FROM runs r JOIN sr s ON r.stream_id = s.stream_id AND r.start_ms < s.end_ms AND r.end_ms > s.start_ms
  WHERE (s.start_ms + s.end_ms BETWEEN r.start_ms * 2 AND r.end_ms * 2)
     OR (least(r.end_ms, s.end_ms) - greatest(r.start_ms, s.start_ms)) * 2 >= s.end_ms - s.start_ms),
al AS (SELECT stream_id, seq, start_ms, end_ms, text, 'kept' AS origin FROM ns WHERE family <> 'error'
  UNION ALL SELECT stream_id, seq, start_ms, end_ms, text, 'recovered' FROM fil
  UNION ALL SELECT stream_id, 0, start_ms, end_ms, '…', 'override' FROM runs r WHERE NOT EXISTS (SELECT 1 FROM fil f WHERE f.stream_id = r.stream_id AND f.g = r.g))
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, origin, seq) AS new_seq, start_ms, end_ms, text, origin FROM al""".replace("),\nns AS", "),\nns AS"))
def join11(spark, sf):
    from tidemark.operators.ordered import position

    ev, order = chunked_events(events(spark, sf))
    rows = position(ev.where("family <> 'signup'"), order, "n").select("stream_id", F.col("n").alias("seq"), "start_ms", "end_ms", "text", "family")
    return iv.cut_and_recover(rows, F.col("family") == "error", ev.where("family = 'signup'"), BUCKET).select(
        "stream_id", "new_seq", "start_ms", "end_ms", "text", "origin"
    )


@query("join6_gap_recovery", with_(EV, SIDES, GAPS % ("a", "a", HOUR)) + f""",
ins AS (SELECT b.*, g.gap_start, g.gap_end FROM b JOIN gaps g ON b.stream_id = g.stream_id AND b.start_ms >= g.gap_start - 80 AND b.end_ms <= g.gap_end + 80),
nb AS (SELECT i.stream_id, i.seq, i.gap_start, string_agg(a.text, '' ORDER BY a.start_ms, a.end_ms, a.seq) AS near FROM ins i JOIN a ON a.stream_id = i.stream_id
   AND (abs(a.end_ms - i.gap_start) < {3 * HOUR} OR abs(a.start_ms - i.gap_end) < {3 * HOUR}) GROUP BY ALL),
rs AS (SELECT i.stream_id, i.seq, i.gap_start, i.gap_end, CASE WHEN i.end_ms - i.start_ms > {4 * HOUR} THEN 'overlong_span'
     WHEN {sql_jaccard(sql_squeeze('i.text'), sql_squeeze("coalesce(nb.near, '')"))} >= 0.45 THEN 'nearby_duplicate' ELSE '' END AS reject_reasons
  FROM ins i LEFT JOIN nb ON i.stream_id = nb.stream_id AND i.seq = nb.seq AND i.gap_start = nb.gap_start)
SELECT stream_id, seq, gap_start, gap_end, reject_reasons, CASE WHEN reject_reasons = '' THEN 'accepted' ELSE 'rejected' END AS decision FROM rs""")
def join6(spark, sf):
    a, b = sides(spark, sf)
    a, order = chunked_events(a)
    rivals = b.withColumn("span_ms", F.col("end_ms") - F.col("start_ms") + 2)
    out = iv.recover_gaps(a, rivals, durations(a), 2 * DAY, HOUR, 80, 3 * HOUR, 4 * HOUR, 0.45, order)
    return out.select(
        "stream_id", "seq", F.col("gap_start").cast("long").alias("gap_start"), F.col("gap_end").cast("long").alias("gap_end"),
        F.array_join("reject_reasons", ",").alias("reject_reasons"), "decision",
    )


@query("join7_nearest_assets", with_(EV, SIDES) + """,
anc AS (SELECT stream_id, seq, unnest([start_ms, CAST(floor((start_ms + end_ms) / 2) AS BIGINT), end_ms]) AS at, unnest([0, 1, 2]) AS k FROM a),
c AS MATERIALIZED (SELECT n.stream_id, n.seq, n.k, b.seq AS path, row_number() OVER (PARTITION BY n.stream_id, n.seq, n.k ORDER BY abs(n.at - b.start_ms), b.start_ms, b.seq) AS rn
      FROM anc n JOIN b ON n.stream_id = b.stream_id),
s0 AS MATERIALIZED (SELECT stream_id, seq, path FROM c WHERE k = 0 AND rn = 1),
s1 AS MATERIALIZED (SELECT stream_id, seq, path FROM (SELECT c.*, row_number() OVER (PARTITION BY c.stream_id, c.seq ORDER BY c.rn) AS q FROM c JOIN s0 USING (stream_id, seq) WHERE c.k = 1 AND c.path <> s0.path) WHERE q = 1),
s2 AS (SELECT stream_id, seq, path FROM (SELECT c.*, row_number() OVER (PARTITION BY c.stream_id, c.seq ORDER BY c.rn) AS q FROM c JOIN s0 USING (stream_id, seq)
   LEFT JOIN s1 USING (stream_id, seq) WHERE c.k = 2 AND c.path <> s0.path AND c.path IS DISTINCT FROM s1.path) WHERE q = 1)
SELECT s0.stream_id, s0.seq, CAST(s0.path AS VARCHAR) AS path_start, CAST(s1.path AS VARCHAR) AS path_middle, CAST(s2.path AS VARCHAR) AS path_end
FROM s0 LEFT JOIN s1 USING (stream_id, seq) LEFT JOIN s2 USING (stream_id, seq)""")
def join7(spark, sf):
    a, b = sides(spark, sf)
    assets = b.select("stream_id", F.col("start_ms").alias("at_ms"), F.col("seq").alias("path"), F.col("seq").alias("sha"))
    out = iv.nearest_assets(a, assets, chunk_ms=CHUNK)
    return out.select("stream_id", "seq", *[F.col(c).cast("string").alias(c) for c in ("path_start", "path_middle", "path_end")])
