"""Rule audits on document lines and derived pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.frames import LINE_ORDER, LN, TN, lines, sql_compact, sql_key, sql_squeeze, table, turns, with_
from tidemark.catalog.interval_queries import BUCKET, LEFT, RIGHT, SIDES, PAIRS, EV, events, family
from tidemark.catalog.registry import query
from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded
from tidemark.operators import audits as au
from tidemark.operators import intervals as iv
from tidemark.operators.ordered import neighbour

L = F.lit
RULES = au.SegmentRules(forbidden=r"[ßÄÖÜ]", placeholders=("xx",), work_tags=("%%%",))

SQL_CPS = f"(CASE WHEN end_ms > start_ms THEN length({sql_compact('text')}) * 1000.0 / (end_ms - start_ms) END)"
ISSUES = f"""a AS (SELECT *, {sql_squeeze('text')} AS key, length({sql_compact('text')}) AS solid, CAST(length({sql_compact('text')}) * 1000.0 AS DOUBLE) / nullif(end_ms - start_ms, 0) AS cps,
   string_split(text, chr(10)) AS li FROM ln),
b AS (SELECT *, lag(key) OVER (PARTITION BY stream_id ORDER BY seq) AS pk FROM a),
iss AS (
  SELECT stream_id, seq, 'empty_text' AS code, 'error' AS severity, NULL AS detail FROM b WHERE key = ''
  UNION ALL SELECT stream_id, seq, 'forbidden_script', 'error', NULL FROM b WHERE regexp_matches(text, '[ßÄÖÜ]')
  UNION ALL SELECT stream_id, seq, 'placeholder', 'error', 'xx' FROM b WHERE contains(text, 'xx')
  UNION ALL SELECT stream_id, seq, 'work_tag', 'error', '%%%' FROM b WHERE contains(text, '%%%')
  UNION ALL SELECT stream_id, seq, 'broken_character', 'error', NULL FROM b WHERE contains(text, '�')
  UNION ALL SELECT stream_id, seq, 'control_character', 'error', NULL FROM b WHERE regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')
  UNION ALL SELECT stream_id, seq, 'abnormal_space', 'warning', NULL FROM b WHERE regexp_matches(text, ' {{2,}}|\\t')
  UNION ALL SELECT stream_id, seq, 'repeated_punctuation', 'warning', NULL FROM b WHERE regexp_matches(text, '[!?！？。]{{2,}}|\\.{{3,}}')
  UNION ALL SELECT stream_id, seq, 'too_many_lines', 'error', NULL FROM b WHERE len(li) > 2
  UNION ALL SELECT stream_id, seq, 'high_cps', 'warning', 'inf' FROM b WHERE end_ms <= start_ms
  UNION ALL SELECT stream_id, seq, 'high_cps', 'warning', CAST(round(cps, 2) AS VARCHAR) FROM b WHERE end_ms > start_ms AND cps > 16
  UNION ALL SELECT stream_id, seq, 'fragment_candidate', 'warning', NULL FROM b WHERE end_ms - start_ms >= 1000 AND solid < 2
  UNION ALL SELECT stream_id, seq, 'consecutive_duplicate', 'warning', NULL FROM b WHERE key <> '' AND key = pk
  UNION ALL SELECT stream_id, seq, 'question_regression_candidate', 'warning', NULL FROM b WHERE suffix(rtrim(text), '.') AND contains(text, '?')
  UNION ALL SELECT stream_id, seq, 'long_line', 'warning', CAST(length(x) AS VARCHAR) FROM (SELECT stream_id, seq, unnest(li) AS x FROM b) WHERE length(x) > 42
  UNION ALL SELECT stream_id, NULL, 'reused_candidate', 'warning', CAST(count(*) AS VARCHAR) || 'x' || key FROM b WHERE key <> '' GROUP BY stream_id, key HAVING count(*) >= 3)"""


@query("aud1_segment_issues", with_(LN, ISSUES) + "SELECT * FROM iss")
def aud1(spark, sf):
    return au.segment_issues(lines(spark, sf), LINE_ORDER, RULES)


@query("aud1_stream_status", with_(LN, ISSUES) + """
SELECT l.stream_id, coalesce(n, 0) AS issues, CASE WHEN e THEN 'fail' WHEN n > 0 THEN 'warning' ELSE 'pass' END AS status
FROM (SELECT DISTINCT stream_id FROM ln) l LEFT JOIN (SELECT stream_id, count(*) AS n, bool_or(severity = 'error') AS e FROM iss GROUP BY stream_id) i USING (stream_id)""")
def aud1b(spark, sf):
    rows = lines(spark, sf)
    return au.stream_status(au.segment_issues(rows, LINE_ORDER, RULES), table(spark, sf, "documents").select(F.col("doc_id").alias("stream_id")))


PAIR_RULES = au.PairRules(
    rules=(
        au.PairRule("question_not_preserved", r"\?", r"\?"),
        au.PairRule("negation_not_preserved", r"(?i)(^|[^\p{L}])(not|nicht|no|ne)($|[^\p{L}])", r"(?i)(^|[^\p{L}])(not|nicht|no|ne)($|[^\p{L}])", "possible_added_negation"),
        au.PairRule("request_not_preserved", r"(?i)(^|[^\p{L}])(the|der|la)($|[^\p{L}])", r"(?i)(^|[^\p{L}])(the|der|la)($|[^\p{L}])"),
    ),
    number=r"[0-9]+",
)
TARGETS = """pr AS (SELECT stream_id, seq, text AS source, CASE WHEN seq % 3 = 0 THEN regexp_replace(text, '[0-9]', '', 'g') ELSE text || ' ne 7' END AS target_a,
  CASE WHEN length(text) % 3 = 0 THEN replace(replace(lower(text), 'the', ''), '?', '') WHEN length(text) % 11 = 0 THEN '' ELSE text END AS target_b FROM ln)"""


def pair_lines(spark, sf):
    return lines(spark, sf).select(
        "stream_id", "seq", F.col("text").alias("source"),
        F.when(F.col("seq") % 3 == 0, F.regexp_replace("text", "[0-9]", "")).otherwise(F.concat("text", L(" ne 7"))).alias("target_a"),
        F.when(F.length("text") % 3 == 0, F.replace(F.replace(F.lower("text"), L("the"), L("")), L("?"), L("")))
        .when(F.length("text") % 11 == 0, "").otherwise(F.col("text")).alias("target_b"),
    )


def sql_fail(t: str, s: str = "source") -> str:
    neg, req = r"(?i)(^|[^\p{L}])(not|nicht|no|ne)($|[^\p{L}])", r"(?i)(^|[^\p{L}])(the|der|la)($|[^\p{L}])"
    need, have = f"regexp_extract_all({s}, '[0-9]+')", f"regexp_extract_all({t}, '[0-9]+')"
    lost = f"len(list_filter(list_distinct({need}), lambda x: len(list_filter({have}, lambda y: y = x)) < len(list_filter({need}, lambda z: z = x)))) > 0"
    return f"""list_filter([CASE WHEN trim({t}) = '' THEN 'empty_target' END, CASE WHEN contains({s}, '?') AND NOT contains({t}, '?') THEN 'question_not_preserved' END,
  CASE WHEN regexp_matches({s}, '{neg}') AND NOT regexp_matches({t}, '{neg}') THEN 'negation_not_preserved' END,
  CASE WHEN regexp_matches({s}, '{req}') AND NOT regexp_matches({t}, '{req}') THEN 'request_not_preserved' END,
  CASE WHEN {lost} THEN 'numbers_not_preserved' END], lambda c: c IS NOT NULL)"""


def sql_warn(t: str) -> str:
    neg = r"(?i)(^|[^\p{L}])(not|nicht|no|ne)($|[^\p{L}])"
    return f"(NOT regexp_matches(source, '{neg}') AND regexp_matches({t}, '{neg}'))"


@query("aud5_pair_preservation", with_(LN, TARGETS, f"""q AS (SELECT *, {sql_fail('target_a')} AS fa, {sql_fail('target_b')} AS fb, {sql_warn('target_a')} OR {sql_warn('target_b')} AS w FROM pr),
r AS (SELECT *, list_sort(list_distinct(list_concat(fa, fb))) AS h FROM q)""") + """
SELECT stream_id, seq, array_to_string(h, ',') AS hard_failures, CASE WHEN w THEN 'possible_added_negation' ELSE '' END AS warnings,
  CAST(greatest(0, 100 - least(75, len(h) * 25) - CASE WHEN w THEN 5 ELSE 0 END) AS DOUBLE) / 100 AS score, CASE WHEN len(h) > 0 THEN 'fallback' ELSE 'passed' END AS status,
  len(fa) = 0 AS target_a_safe, len(fb) = 0 AS target_b_safe FROM r""")
def aud5(spark, sf):
    out = au.audit_pairs(pair_lines(spark, sf), PAIR_RULES)
    return out.select(
        "stream_id", "seq", F.array_join("hard_failures", ",").alias("hard_failures"), F.array_join("warnings", ",").alias("warnings"),
        F.col("score").cast("double").alias("score"), "status", "target_a_safe", "target_b_safe",
    )


SCENE_CTE = f"""un AS (SELECT stream_id, seq // 4 AS scene, seq, start_ms, end_ms, text FROM ln),
cu AS (SELECT stream_id, seq // 4 AS scene, seq, CASE WHEN seq % 5 = 0 THEN replace(text, '?', '') WHEN seq % 7 = 0 THEN regexp_replace(text, '[0-9]', '', 'g') ELSE text END AS text, seq // 2 AS tid
  FROM ln WHERE NOT (stream_id % 6 = 1 AND seq % 13 = 3)
  UNION ALL SELECT stream_id, seq // 4, seq, text, seq // 2 FROM ln WHERE stream_id % 9 = 4 AND seq % 17 = 5),
bd AS (SELECT DISTINCT coalesce(u.stream_id, c.stream_id) AS stream_id, coalesce(u.scene, c.scene) AS scene FROM un u
  FULL JOIN (SELECT stream_id, scene, seq, count(*) AS n FROM cu GROUP BY ALL) c ON u.stream_id = c.stream_id AND u.scene = c.scene AND u.seq = c.seq WHERE u.seq IS NULL OR c.n IS NULL OR c.n <> 1),
fi AS (SELECT c.*, u.start_ms, u.end_ms, u.text AS source FROM cu c JOIN un u ON c.stream_id = u.stream_id AND c.seq = u.seq ANTI JOIN bd ON c.stream_id = bd.stream_id AND c.scene = bd.scene),
gr AS (SELECT stream_id, scene, string_agg(CAST(seq AS VARCHAR), '+' ORDER BY seq) AS members, string_agg(source, ' ' ORDER BY seq) AS source, string_agg(text, ' ' ORDER BY seq) AS target FROM fi GROUP BY stream_id, scene, tid),
al AS (SELECT stream_id, scene, '' AS members, 'unit_coverage' AS code, 'error' AS severity FROM bd
  UNION ALL SELECT stream_id, scene, CAST(seq AS VARCHAR), 'invalid_character', 'error' FROM fi WHERE regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')
  UNION ALL SELECT stream_id, scene, CAST(seq AS VARCHAR), 'reading_speed', 'warning' FROM fi WHERE length({sql_compact('text')}) * 1000.0 / greatest(end_ms - start_ms, 1) > 20
  UNION ALL SELECT stream_id, scene, CAST(seq AS VARCHAR), 'line_length', 'warning' FROM fi WHERE length(text) > 42
  UNION ALL SELECT stream_id, scene, members, unnest({sql_fail('target')}), 'review' FROM gr)"""


@query("aud6_scene_audit", with_(LN, SCENE_CTE) + "SELECT DISTINCT * FROM al")
def aud6(spark, sf):
    rows = lines(spark, sf).withColumn("scene", F.floor(F.col("seq") / 4))
    units = rows.select("stream_id", "scene", "seq", "start_ms", "end_ms", "text")
    cue = F.when(F.col("seq") % 5 == 0, F.replace("text", L("?"), L(""))).when(F.col("seq") % 7 == 0, F.regexp_replace("text", "[0-9]", "")).otherwise(F.col("text"))
    turn = F.array(F.floor(F.col("seq") / 2))
    cues = rows.where(~((F.col("stream_id") % 6 == 1) & (F.col("seq") % 13 == 3))).select("stream_id", "scene", "seq", cue.alias("text"), turn.alias("turn_ids"))
    extra = rows.where((F.col("stream_id") % 9 == 4) & (F.col("seq") % 17 == 5)).select("stream_id", "scene", "seq", "text", turn.alias("turn_ids"))
    return au.scene_audit(units, cues.unionByName(extra), PAIR_RULES)


@query("aud7_quality_class", with_(LN, ISSUES) + """,
c AS (SELECT l.stream_id, l.seq, bool_or(i.code IN ('empty_text', 'control_character', 'broken_character')) AS u, bool_or(i.code IN ('high_cps', 'consecutive_duplicate', 'abnormal_space')) AS s
  FROM ln l LEFT JOIN iss i ON l.stream_id = i.stream_id AND l.seq = i.seq GROUP BY ALL)
SELECT stream_id, seq, CASE WHEN coalesce(u, false) THEN 'unusable' WHEN coalesce(s, false) OR seq % 19 = 0 THEN 'suspect' ELSE 'trusted' END AS quality FROM c""")
def aud7(spark, sf):
    rows = lines(spark, sf)
    codes = au.segment_issues(rows, LINE_ORDER, RULES).where("seq is not null").groupBy("stream_id", "seq").agg(F.collect_set("code").alias("codes"))
    out = rows.select("stream_id", "seq").join(codes, ["stream_id", "seq"], "left").withColumn("codes", F.coalesce("codes", F.array()))
    explicit = F.when(F.col("seq") % 19 == 0, "suspect")
    q = au.quality_class(F.col("codes"), ("empty_text", "control_character", "broken_character"), ("high_cps", "consecutive_duplicate", "abnormal_space"), explicit)
    return out.select("stream_id", "seq", q.alias("quality"))


RISK = au.RiskRules(question=r"\?", negation=r"(?i)(^|[^\p{L}])(not|nicht|ne)($|[^\p{L}])", action=r"(?i)(ing|tion|ung)", long_chars=42, short_ms=3000)


@query("aud8_risk_band", with_(EV, SIDES, PAIRS) + f""",
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, seq ORDER BY overlap_ms DESC, abs(start_ms - r_start_ms), r_start_ms, r_end_ms, r_seq) AS rn FROM p WHERE overlap_ms > 0) WHERE rn = 1),
d AS (SELECT a.stream_id, a.seq, a.start_ms, a.end_ms, dd.text, CASE WHEN m.r_seq IS NOT NULL THEN CASE WHEN m.r_seq % 2 = 0 THEN dd.text ELSE m.r_text END ELSE '' END AS prev
  FROM a JOIN (SELECT doc_id, text FROM documents) dd ON dd.doc_id = a.seq % 1000 LEFT JOIN m ON m.stream_id = a.stream_id AND m.seq = a.seq),
f AS (SELECT *, length({sql_compact('text')}) > 42 AS f1, len(string_split(text, chr(10))) > 2 AS f2, contains(text, '?') AS f3, regexp_matches(text, '(?i)(^|[^\\p{{L}}])(not|nicht|ne)($|[^\\p{{L}}])') AS f4,
  regexp_matches(text, '(?i)(ing|tion|ung)') AS f5, end_ms - start_ms < 3000 AND length({sql_compact('text')}) > 10 AS f6, prev <> '' AND prev = text AS f7 FROM d),
s AS (SELECT *, least(100, 22 * CAST(f1 AS INT) + 18 * CAST(f2 AS INT) + 22 * CAST(f3 AS INT) + 28 * CAST(f4 AS INT) + 22 * CAST(f5 AS INT) + 12 * CAST(f6 AS INT) + 10 * CAST(f7 AS INT)) AS sc FROM f)
SELECT stream_id, seq, CAST(sc AS BIGINT) AS risk_score, CASE WHEN sc >= 72 THEN 'P1' WHEN sc >= 45 THEN 'P2' WHEN sc >= 28 THEN 'P3' ELSE 'P4' END AS band FROM s""")
def aud8(spark, sf):
    ev = events(spark, sf)
    a, b = family(ev, *LEFT), family(ev, *RIGHT)
    best = iv.best_overlap(a, b, BUCKET, payload=("text",)).drop("text")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = best.join(docs, F.col("doc_id") == F.col("seq") % 1000)
    previous = F.when(F.col("match_seq").isNull(), "").when(F.col("match_seq") % 2 == 0, F.col("text")).otherwise(F.col("match_text"))
    return au.risk_band(rows.withColumn("previous_text", previous), RISK).select("stream_id", "seq", "risk_score", "band")


CLASSES = {"plain": "[A-Za-z]", "accented": "[À-ÖØ-öø-ÿ]", "digits": "[0-9]"}


@query("aud9_script_shares", """WITH c AS (SELECT doc_id AS stream_id, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS plain,
 CAST(len(regexp_extract_all(text, '[À-ÖØ-öø-ÿ]')) AS BIGINT) AS accented, CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS digits FROM documents),
t AS (SELECT *, plain + accented + digits AS tot FROM c)
SELECT stream_id, plain, accented, digits, round(CASE WHEN tot > 0 THEN CAST(plain AS DOUBLE) / tot END, 6) AS plain_share,
 CASE WHEN plain >= 4 AND plain >= 0.6 * tot AND plain > greatest(accented, digits) THEN 'plain' WHEN accented >= 4 AND accented >= 0.6 * tot AND accented > greatest(plain, digits) THEN 'accented'
      WHEN digits >= 4 AND digits >= 0.6 * tot AND digits > greatest(plain, accented) THEN 'digits' END AS dominant FROM t""")
def aud9(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("stream_id"), "text")
    out = au.script_shares(docs, CLASSES)
    return out.select("stream_id", "plain", "accented", "digits", rounded("plain_share", 6).alias("plain_share"), "dominant")


@query("aud10_residual_counts", """WITH d AS (SELECT source AS stream_id, text AS before, regexp_replace(text, 'é', 'e', 'g') AS after FROM documents)
SELECT stream_id, count(*) FILTER (regexp_matches(before, '[éè]')) AS before_blocks,
  CAST(sum(len(list_filter(string_split(before, chr(10)), lambda x: regexp_matches(x, '[éè]')))) AS BIGINT) AS before_lines, CAST(sum(len(regexp_extract_all(before, '[éè]'))) AS BIGINT) AS before_chars,
  count(*) FILTER (regexp_matches(after, '[éè]')) AS after_blocks,
  CAST(sum(len(list_filter(string_split(after, chr(10)), lambda x: regexp_matches(x, '[éè]')))) AS BIGINT) AS after_lines, CAST(sum(len(regexp_extract_all(after, '[éè]'))) AS BIGINT) AS after_chars
FROM d GROUP BY stream_id""")
def aud10(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("stream_id"), F.col("text").alias("before"), F.replace("text", L("é"), L("e")).alias("after"))
    return au.residual_counts(docs, "[éè]", ["before", "after"])


@query("aud11_reliable_evidence", with_(LN) + f"""
SELECT stream_id, count(*) AS candidates FROM ln WHERE NOT (-(length(text) % 17) / 10.0 < -1.2) AND length(text) % 31 / 10.0 <= 2.4
  AND {sql_key('text')} NOT IN (SELECT {sql_key('text')} FROM ln GROUP BY 1 HAVING count(*) >= 20) GROUP BY stream_id""")
def aud11(spark, sf):
    rows = lines(spark, sf).withColumns({"avg_logprob": -(F.length("text") % 17) / 10.0, "compression_ratio": F.length("text") % 31 / 10.0})
    banned = rows.groupBy(tx.word_key(F.col("text")).alias("text")).agg(F.count("*").alias("n")).where("n >= 20")
    return au.reliable_evidence(rows, banned).groupBy("stream_id").agg(F.count("*").alias("candidates"))


SUITE = """o AS (SELECT l.doc_id, l.quality, d.text, d.lang, length(d.text) % 4 AS fam, length(d.text) % 23 AS cps FROM labels l JOIN documents d USING (doc_id)),
f AS (SELECT *, list_sort(list_filter([CASE WHEN NOT contains(text, 'e') OR NOT contains(text, 'th') THEN 'missing_required_text' END, CASE WHEN contains(text, 'Nicht') THEN 'forbidden_text' END,
  CASE WHEN doc_id % 2 = 0 AND lang <> 'en' THEN 'wrong_register' END, CASE WHEN doc_id % 5 = 0 AND doc_id % 10 <> 0 THEN 'missing_reference' END,
  CASE WHEN doc_id % 7 = 0 AND NOT length(text) % 2 = 0 THEN 'did_not_abstain' END, CASE WHEN fam < 1 THEN 'too_few_families' END, CASE WHEN cps > 20 THEN 'reading_speed' END], lambda x: x IS NOT NULL)) AS found,
  CASE WHEN quality = 1 THEN [] WHEN doc_id % 2 = 0 THEN ['wrong_register'] ELSE ['missing_required_text'] END AS expected FROM o),
s AS (SELECT *, list_sort(list_filter(expected, lambda x: NOT list_contains(found, x))) AS missed FROM f),
h AS (SELECT *, CASE WHEN quality = 1 THEN len(found) = 0 ELSE len(missed) = 0 AND len(found) > 0 END AS holds FROM s)"""


def suite(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    cid = F.col("doc_id")
    empty = F.array().cast("array<string>")
    cases = rows.select(
        cid.alias("case_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("kind"),
        F.array(L("e"), L("th")).alias("required_text"), F.array(L("Nicht")).alias("forbidden_text"),
        F.when(cid % 2 == 0, "en").alias("required_register"), F.when(cid % 5 == 0, F.array(L("r1"))).otherwise(empty).alias("required_refs"),
        (cid % 7 == 0).alias("must_abstain"), L(1).alias("min_families"), L(20.0).alias("max_cps"),
        F.when(F.col("quality") == 1, empty).when(cid % 2 == 0, F.array(L("wrong_register"))).otherwise(F.array(L("missing_required_text"))).alias("expected_codes"),
    )
    size = F.length("text")
    outcomes = table(spark, sf, "documents").select(
        cid.alias("case_id"), F.col("text").alias("out_text"), F.col("lang").alias("out_register"),
        F.when(cid % 10 == 0, F.array(L("r1"))).otherwise(empty).alias("out_refs"), (size % 2 == 0).alias("out_abstained"),
        (size % 4).alias("out_families"), (size % 23).cast("double").alias("out_cps"),
    )
    return au.expectation_suite(cases, outcomes)


@query("aud12_expectation_suite", with_(SUITE) + "SELECT doc_id AS case_id, array_to_string(found, ',') AS found, array_to_string(missed, ',') AS missed, holds FROM h")
def aud12(spark, sf):
    return suite(spark, sf).select("case_id", F.array_join("found", ",").alias("found"), F.array_join("missed", ",").alias("missed"), "holds")


@query("aud12_expectation_summary", with_(SUITE) + """SELECT count(*) FILTER (quality = 0) AS hazards, count(*) FILTER (quality = 0 AND NOT holds) AS missed_hazards,
 count(*) FILTER (quality = 1) AS clean, count(*) FILTER (quality = 1 AND NOT holds) AS clean_regressions, bool_and(holds) AS passed FROM h""")
def aud12b(spark, sf):
    return au.expectation_summary(suite(spark, sf))
