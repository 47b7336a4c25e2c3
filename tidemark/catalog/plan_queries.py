"""Alignment and composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.evidence_queries import ALIASES, CAND, FLIPS, FUSE, WIT, candidates, witnesses
from tidemark.catalog.frames import EV, HOUR, MONTH, DAY, TN, chunked_events, events, sql_jaccard, sql_key, turns, with_
from tidemark.catalog.interval_queries import BUCKET, durations, sides
from tidemark.catalog.registry import query
from tidemark.functions.numbers import rounded
from tidemark.operators import alignment as al
from tidemark.operators import audits as au
from tidemark.operators import overlay as ov
from tidemark.operators.ordered import Order, chunked
from tidemark.plans import pipelines as pl

L = F.lit


def two_lists(spark, sf):
    left = turns(spark, sf)
    k = F.col("seq")
    right = left.where((k + F.col("stream_id")) % 5 != 0).withColumns(
        {"seq": k * 2 + 1, "text": F.when(k % 3 == 0, F.upper("text")).when(k % 3 == 1, F.substring("text", 1, 60)).otherwise(F.col("text")), "start_ms": F.col("start_ms") + 700}
    )
    return left, right


ALIGN = ("""sides AS (SELECT stream_id, seq, start_ms, text AS lt, CASE WHEN (seq + stream_id) % 5 <> 0 THEN CASE seq % 3 WHEN 0 THEN upper(replace(text, 'ß', 'SS')) WHEN 1 THEN substr(text, 1, 60) ELSE text END END AS rt FROM tn)""",
f"""lf AS (SELECT stream_id, seq, {sql_key('lt')} AS key, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS i FROM sides),
rf AS (SELECT stream_id, seq * 2 + 1 AS seq, start_ms + 700 AS start_ms, {sql_key('rt')} AS key, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS j FROM sides WHERE rt IS NOT NULL),
sm AS (SELECT l.stream_id, l.i, list({sql_jaccard('l.key', 'r.key')} ORDER BY r.j) AS s FROM lf l JOIN rf r ON l.stream_id = r.stream_id GROUP BY l.stream_id, l.i)""",
"""tb(stream_id, i, cells) AS (
  SELECT stream_id, CAST(0 AS BIGINT), list_transform(range(0, count(*) + 1), lambda j: {'score': -0.25::DOUBLE * j, 'path': CAST([] AS STRUCT(i BIGINT, j BIGINT, s DOUBLE)[])}) FROM rf GROUP BY stream_id
  UNION ALL
  SELECT t.stream_id, t.i + 1, list_reduce(list_transform(t.cells, lambda c: [{'score': t.cells[1].score - 0.45::DOUBLE, 'path': t.cells[1].path}]), lambda made, c: list_append(made,
    CASE WHEN t.cells[len(made) + 1].score - 0.45::DOUBLE >= made[len(made)].score - 0.25::DOUBLE
          AND t.cells[len(made) + 1].score - 0.45::DOUBLE >= t.cells[len(made)].score + 2.4::DOUBLE * m.s[len(made)] - 1.0::DOUBLE
         THEN {'score': t.cells[len(made) + 1].score - 0.45::DOUBLE, 'path': t.cells[len(made) + 1].path}
         WHEN made[len(made)].score - 0.25::DOUBLE >= t.cells[len(made)].score + 2.4::DOUBLE * m.s[len(made)] - 1.0::DOUBLE
         THEN {'score': made[len(made)].score - 0.25::DOUBLE, 'path': made[len(made)].path}
         ELSE {'score': t.cells[len(made)].score + 2.4::DOUBLE * m.s[len(made)] - 1.0::DOUBLE,
               'path': list_append(t.cells[len(made)].path, {'i': t.i + 1, 'j': CAST(len(made) AS BIGINT), 's': m.s[len(made)]})} END))
  FROM tb t JOIN sm m ON t.stream_id = m.stream_id AND m.i = t.i + 1)""",
"""al AS (SELECT p.stream_id, lf.seq, rf.seq AS match_seq, rf.start_ms AS anchor, p.x.s AS similarity
  FROM (SELECT stream_id, unnest(arg_max(cells[len(cells)].path, i)) AS x FROM tb GROUP BY stream_id) p
  JOIN lf ON lf.stream_id = p.stream_id AND lf.i = p.x.i JOIN rf ON rf.stream_id = p.stream_id AND rf.j = p.x.j)""")


@query("join20_sequence_alignment", "WITH RECURSIVE " + ",\n".join((TN, *ALIGN)) + "\nSELECT stream_id, seq, match_seq, round(similarity, 6) AS similarity FROM al")
def join20(spark, sf):
    left, right = two_lists(spark, sf)
    return al.align_sequences(left, right, similar="bigram").withColumn("similarity", rounded("similarity", 6))


@query("join20_retime", "WITH RECURSIVE " + ",\n".join((TN, *ALIGN, """a AS (SELECT l.stream_id, l.seq, l.i, CASE WHEN x.similarity >= 0.5 THEN CAST(x.anchor AS DOUBLE) END AS an, count(*) OVER (PARTITION BY l.stream_id) AS n FROM lf l LEFT JOIN al x USING (stream_id, seq)),
b AS (SELECT *, max(CASE WHEN an IS NOT NULL THEN i END) OVER (PARTITION BY stream_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS ai,
  min(CASE WHEN an IS NOT NULL THEN i END) OVER (PARTITION BY stream_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi FROM a),
c AS (SELECT b.*, x.an AS t0, y.an AS t1 FROM b LEFT JOIN a x ON x.stream_id = b.stream_id AND x.i = b.ai LEFT JOIN a y ON y.stream_id = b.stream_id AND y.i = b.bi),
d AS (SELECT *, CASE WHEN ai IS NULL AND bi IS NULL THEN NULL WHEN ai IS NULL THEN 0 + greatest(100.0, t1 - 0) * i / bi
   WHEN bi IS NULL THEN t0 + greatest(100.0, 10000000.0 - t0) * (i - ai) / (n - ai + 1) WHEN ai = bi THEN t0 ELSE t0 + (t1 - t0) * (i - ai) / (bi - ai) END AS raw FROM c)""")) + """
SELECT stream_id, seq, round(max(raw - i * 50) OVER (PARTITION BY stream_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 50, 3) AS new_start FROM d""")
def join20b(spark, sf):
    left, right = two_lists(spark, sf)
    df, order = chunked(left, Order(by=("seq",)), 1000)
    out = al.retime(df, right, order, L(0.0), L(10_000_000.0), 0.5, "bigram")
    return out.select("stream_id", "seq", rounded("new_start", 3).alias("new_start"))


@query("plan_transcript_quality")
def plan_transcript(spark, sf):
    a, b = sides(spark, sf)
    a = a.withColumns({"compression_ratio": F.col("k") / 30.0, "avg_logprob": -F.col("k") / 60.0, "no_speech_prob": F.col("k") / 100.0})
    a, order = chunked_events(a)
    rivals = b.withColumn("span_ms", F.col("end_ms") - F.col("start_ms") + 2)
    out = pl.transcript_plan(a, rivals, durations(a), order, 2 * DAY, min_gap_ms=HOUR, near_ms=3 * HOUR, longest_ms=4 * HOUR)["quality"]
    return out.select("stream_id", "cues", "min_ms", "max_ms", "overlap_rows", "reversals", "gate")


@query("plan_decision_coverage", with_(EV, CAND, """dd AS (SELECT stream_id, seq FROM sg WHERE seq % 5 <> 0 UNION ALL SELECT stream_id, seq FROM sg WHERE seq % 7 = 0 UNION ALL SELECT stream_id, seq + 1000 FROM sg WHERE seq % 11 = 0),
dn AS (SELECT stream_id, seq, count(*) AS n FROM dd GROUP BY ALL)""") + """
SELECT stream_id, seq, 'missing' AS issue FROM sg LEFT JOIN dn USING (stream_id, seq) WHERE n IS NULL
UNION ALL SELECT stream_id, seq, 'extra' FROM dn LEFT JOIN (SELECT stream_id, seq, 1 AS w FROM sg) x USING (stream_id, seq) WHERE w IS NULL
UNION ALL SELECT stream_id, seq, 'duplicate' FROM dn WHERE n > 1""")
def plan_decisions(spark, sf):
    """The plan's decisions with some lost, some made twice and some for segments that don't exist."""
    cand = candidates(spark, sf)
    none = F.array().cast("array<string>")
    seg = cand.select("stream_id", "seq").distinct().withColumn("reasons", none)
    made = pl.decision_plan(seg, cand, None)["decisions"].select("stream_id", "seq")
    strange = made.where("seq % 11 = 0").withColumn("seq", F.col("seq") + 1000)
    return ov.key_coverage(seg, made.where("seq % 5 <> 0").unionByName(made.where("seq % 7 = 0")).unionByName(strange))


@query("plan_evidence_queue", with_(EV, WIT, FUSE) + """,
rs AS (SELECT stream_id, seq, 2 AS p, 'witness-conflict' AS code FROM fu WHERE state = 'dual_conflict' UNION ALL SELECT stream_id, seq, 3, 'source-not-trusted' FROM fu WHERE seq % 3 <> 0
  UNION ALL SELECT stream_id, seq, 1, 'question_not_preserved' FROM fu WHERE seq % 4 = 1),
g AS (SELECT stream_id, seq, min(p) AS p, array_to_string(list_transform(list_sort(list_distinct(list({'p': p, 'code': code}))), lambda x: x.code), ',') AS reason_codes FROM rs GROUP BY ALL)
SELECT stream_id, seq, row_number() OVER (PARTITION BY stream_id ORDER BY p, seq) AS rank, ['critical', 'high', 'medium'][p] AS priority, reason_codes FROM g""")
def plan_evidence(spark, sf):
    w = witnesses(spark, sf).withColumn("family", F.col("label"))
    keys = w.select("stream_id", "seq").distinct()
    k = F.col("seq")
    units = keys.select(
        "stream_id", "seq", F.when(k % 4 == 1, "is it so?").otherwise("it is so").alias("source"), L("it is so").alias("target_a"), L("so it is").alias("target_b"),
        F.when(k % 3 == 0, "trusted").otherwise("suspect").alias("source_quality"),
    )
    rules = au.PairRules(rules=(au.PairRule("question_not_preserved", r"\?", r"\?"),))
    out = pl.evidence_plan(units, w, ALIASES, FLIPS, rules, 0.4)["queue"]
    return out.withColumn("reason_codes", F.array_join("reason_codes", ","))
