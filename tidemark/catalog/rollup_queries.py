"""Quality rollups, risk scores and comparisons on lines, turns and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.frames import CHUNK, DAY, EV, HOUR, LINE_ORDER, LN, MONTH, TN, chunked_events, events, lines, sql_compact, sql_jaccard, sql_key, sql_squeeze, sql_width, table, turns, with_
from tidemark.catalog.interval_queries import LEFT, RIGHT, SIDES, family
from tidemark.catalog.registry import query
from tidemark.catalog.sequence_queries import RUNS, sql_runaways
from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded
from tidemark.operators import rollups as ru
from tidemark.operators.ordered import Order, chunked

L = F.lit


@query("agg1_qc_rollup", with_(LN, sql_runaways("ln"), f"""a AS (SELECT *, end_ms - start_ms AS d, max(end_ms) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe, {sql_width('text')} AS w,
   EXISTS (SELECT 1 FROM runaway r WHERE r.stream_id = ln.stream_id AND r.seq = ln.seq) AS ra FROM ln),
b AS (SELECT stream_id, count(*) AS cues, avg(d) AS av, min(d) AS min_ms, max(d) AS max_ms, count(*) FILTER (d < 800) AS short_cues, count(*) FILTER (d > 7000) AS long_cues,
  count(*) FILTER (w > 26) AS too_wide, count(*) FILTER (start_ms < pe - 1) AS overlap_rows, count(*) FILTER (d <= 0) AS reversals, count(*) FILTER (trim(text) = '') AS empty_cues,
  count(*) FILTER (ra) AS runaway, count(*) FILTER (length(text) % 5 = 0) AS wl, max(end_ms) AS dur, bool_or(stream_id % 8 = 3 AND seq = 1) AS mm FROM a GROUP BY stream_id)""") + """
SELECT stream_id, cues, round(av, 4) AS avg_ms, min_ms, max_ms, short_cues, long_cues, too_wide, overlap_rows, reversals, empty_cues, runaway,
  round(CASE WHEN dur > 0 THEN cues * 60000.0 / dur ELSE 0 END, 4) AS cues_per_minute, NOT mm AS content_preserved,
  CASE WHEN overlap_rows + reversals + empty_cues > 0 THEN 'failed' WHEN runaway > 0 OR wl > 0 OR mm THEN 'review_required' ELSE 'passed' END AS gate,
  array_to_string(list_filter([CASE WHEN runaway > 0 THEN 'runaway:' || runaway END, CASE WHEN wl > 0 THEN 'limit:' || wl END, CASE WHEN mm THEN 'content_mismatch:1' END], lambda x: x IS NOT NULL), ',') AS reasons FROM b""")
def agg1(spark, sf):
    rows = lines(spark, sf).withColumn("warnings", F.when(F.length("text") % 5 == 0, F.array(L("limit"))).otherwise(F.array().cast("array<string>")))
    durations = rows.groupBy("stream_id").agg(F.max("end_ms").alias("duration_ms"))
    changed = F.when((F.col("stream_id") % 8 == 3) & (F.col("seq") == 1), F.concat("text", L("x"))).otherwise(F.col("text"))
    out = ru.qc_rollup(rows, LINE_ORDER, durations, ("limit",), source=rows.withColumn("text", changed))
    return out.select(
        "stream_id", "cues", rounded("avg_ms", 4).alias("avg_ms"), "min_ms", "max_ms", "short_cues", "long_cues", "too_wide", "overlap_rows", "reversals", "empty_cues",
        "runaway", rounded("cues_per_minute", 4).alias("cues_per_minute"), "content_preserved", "gate",
        F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["code"], r["count"].cast("string"))), ",").alias("reasons"),
    )


WORDS = """wd AS (SELECT stream_id, seq, start_ms, end_ms, pos, start_ms + pos * 280 - CASE WHEN length(w) % 9 = 0 THEN 400 ELSE 0 END AS ws,
   CASE WHEN length(w) = 1 THEN NULL ELSE start_ms + pos * 280 + length(w) * 60 - 60 - CASE WHEN length(w) % 9 = 0 THEN 400 ELSE 0 END END AS we FROM (
  SELECT *, CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS BIGINT) AS pos, unnest(string_split(text, ' ')) AS w FROM ln))"""


@query("agg2_word_alignment", with_(LN, WORDS, """f AS (SELECT *, we IS NULL AS nf FROM wd),
g AS (SELECT *, max(CASE WHEN NOT nf THEN ws END) OVER (PARTITION BY stream_id, seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM f),
h AS (SELECT *, coalesce(NOT nf AND we <= ws, false) AS np, coalesce(NOT nf AND we - ws > 600, false) AS lw, coalesce(NOT nf AND (ws < start_ms - 50 OR we > end_ms + 50), false) AS os, coalesce(NOT nf AND ws < pm, false) AS nm FROM g)""") + """
SELECT stream_id, count(*) AS total_words, count(*) FILTER (nf) AS non_finite_words, count(*) FILTER (np) AS non_positive_words, count(*) FILTER (lw) AS long_words,
  count(*) FILTER (os) AS outside_words, count(*) FILTER (nm) AS non_monotonic_words, count(DISTINCT CASE WHEN nf OR np OR lw OR os OR nm THEN seq END) AS review_segments FROM h GROUP BY stream_id""")
def agg2(spark, sf):
    rows = lines(spark, sf)
    base = F.col("start_ms")

    def word(w, i):
        early = F.when(F.length(w) % 9 == 0, 400).otherwise(0)
        s = base + i * 280 - early
        return F.struct(w.alias("text"), s.alias("start_ms"), F.when(F.length(w) != 1, s + F.length(w) * 60 - 60).alias("end_ms"))

    rows = rows.withColumn("words", F.transform(F.split("text", " "), word))
    return ru.word_alignment(rows, long_ms=600)


@query("agg3_warning_counts", with_(LN) + """,
w AS (SELECT stream_id, CASE WHEN seq % 10 = 0 THEN 'cue:' || CAST(seq AS VARCHAR) ELSE CAST(seq // 3 AS VARCHAR) || CASE WHEN seq % 4 = 0 THEN ',' || CAST(seq // 3 + 100 AS VARCHAR) ELSE '' END END AS lin, unnest(list_filter([
   CASE WHEN length(text) % 2 = 0 THEN 'even' END, CASE WHEN length(text) % 3 = 0 THEN 'third' END], lambda x: x IS NOT NULL)) AS warning FROM ln)
SELECT stream_id, warning, count(DISTINCT lin) AS n FROM w GROUP BY ALL""")
def agg3(spark, sf):
    third = F.floor(F.col("seq") / 3)
    ids = F.when(F.col("seq") % 10 == 0, F.array().cast("array<bigint>")).when(F.col("seq") % 4 == 0, F.array(third + 100, third, third)).otherwise(F.array(third))
    codes = F.array_compact(F.array(F.when(F.length("text") % 2 == 0, "even"), F.when(F.length("text") % 3 == 0, "third")))
    cues = lines(spark, sf).withColumns({"source_ids": ids, "warnings": codes})
    return ru.warning_counts(cues)


QUALITY = f"""rr AS (SELECT *, CASE WHEN key = '' THEN 0 ELSE count(*) OVER (PARTITION BY stream_id, run) END AS rl, CASE WHEN key = '' THEN 0 ELSE count(*) OVER (PARTITION BY stream_id, key) END AS reuse,
  count(*) OVER (PARTITION BY stream_id) AS n, max(end_ms) OVER (PARTITION BY stream_id) AS en FROM k3),
ck AS (SELECT *, trim(text) = '' AS c1, contains(text, '%%') AS c2, contains(text, 'license') AND start_ms * 100 < en * 97 AS c3, length(key) >= 6 AND rl >= 5 AS c4, length(key) >= 6 AND rl >= 8 AS h4,
  length(key) >= 6 AND reuse >= greatest(8, floor(n * 0.05)) AS c5, length(key) >= 6 AND reuse >= greatest(20, floor(n * 0.15)) AS h5, coalesce(seq % 11 = 0 AND seq % 2 = 0, false) AS c6 FROM rr),
ql AS (SELECT *, list_sort(list_filter([CASE WHEN c1 THEN 'empty-source' END, CASE WHEN c2 THEN 'broken-characters' END, CASE WHEN c3 THEN 'early-boilerplate' END, CASE WHEN c4 THEN 'long-consecutive-repeat' END,
   CASE WHEN c5 THEN 'high-global-reuse' END, CASE WHEN c6 THEN 'dual-witness-conflict' END], lambda x: x IS NOT NULL)) AS reasons,
   c1 OR c2 OR c3 OR (c4 AND h4) OR (c5 AND h5) OR c6 AS hard FROM ck),
qq AS (SELECT *, CASE WHEN hard THEN 'unusable' WHEN len(reasons) > 0 THEN 'suspect' ELSE 'trusted' END AS quality FROM ql)"""


def quality_rows(spark, sf):
    rows = lines(spark, sf)
    evidence = rows.where("seq % 11 = 0").select(
        "stream_id", "seq", F.when(F.col("seq") % 2 == 0, 0.2).otherwise(0.6).alias("source_similarity"), L(0.8).alias("family_agreement")
    )
    return ru.source_quality(rows, LINE_ORDER, "%%", "license", F.length(tx.word_key(F.col("text"))) < 6, evidence)


@query("agg4_source_quality", with_(LN, RUNS, QUALITY) + "SELECT stream_id, seq, quality, array_to_string(reasons, ',') AS reasons, reuse FROM qq")
def agg4(spark, sf):
    out = quality_rows(spark, sf)
    return out.select("stream_id", "seq", "quality", F.array_join("reasons", ",").alias("reasons"), F.col("reuse").cast("long").alias("reuse"))


@query("agg4_source_quality_report", with_(LN, RUNS, QUALITY) + """
SELECT stream_id, count(*) AS segments, count(*) FILTER (quality = 'trusted') AS trusted, count(*) FILTER (quality = 'suspect') AS suspect, count(*) FILTER (quality = 'unusable') AS unusable,
  round(CAST(count(DISTINCT CASE WHEN key <> '' THEN key END) AS DOUBLE) / count(*), 6) AS lexical_diversity, max(rl) AS longest_run FROM qq GROUP BY stream_id""")
def agg4b(spark, sf):
    out = ru.source_quality_report(quality_rows(spark, sf))
    return out.withColumn("lexical_diversity", rounded("lexical_diversity", 6))


RISK = f"""a AS (SELECT *, {sql_squeeze('text')} AS k, {sql_key('text')} <> '' AS sem, end_ms - start_ms AS d FROM ln),
b AS (SELECT *, lag(k) OVER w AS pk, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe FROM a WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
fl AS (SELECT stream_id, count(*) AS segments, CAST(sum(len(regexp_extract_all(text, '[ßÄÖÜ]'))) AS BIGINT) AS forbidden_chars, CAST(sum((length(text) - length(replace(text, 'xxx', ''))) // 3) AS BIGINT) AS placeholders,
  CAST(sum((length(text) - length(replace(text, 'license', ''))) // 7 + (length(text) - length(replace(text, '%%%', ''))) // 3) AS BIGINT) AS boilerplate, count(*) FILTER (d <= 0) AS invalid,
  count(*) FILTER (start_ms < ps) AS out_of_order, count(*) FILTER (start_ms < pe) AS overlap_rows, count(*) FILTER (d < 250 AND sem) AS micro, count(*) FILTER (sem AND k = pk) AS adjacent_duplicates,
  count(*) FILTER (d > 30000 AND sem) AS long_rows, count(*) FILTER (length(text) > 32) AS overlong_lines, CAST(0 AS BIGINT) AS too_many_lines FROM b GROUP BY stream_id),
ex AS (SELECT stream_id, CAST(sum(n - 3) AS BIGINT) AS e FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, k) AS r FROM (
   SELECT stream_id, k, count(*) AS n FROM a WHERE sem GROUP BY ALL HAVING count(*) >= 4)) WHERE r <= 20 GROUP BY stream_id),
rk AS (SELECT fl.*, coalesce(e, 0) AS repeat_excess, CAST(20 * forbidden_chars + 20 * placeholders + 12 * boilerplate + 5 * invalid + 8 * out_of_order + 2 * overlap_rows + 3 * micro + 3 * adjacent_duplicates
  + 2 * long_rows + coalesce(e, 0) + overlong_lines + 2 * too_many_lines AS BIGINT) AS risk_score FROM fl LEFT JOIN ex USING (stream_id))"""


def risk(spark, sf):
    return ru.stream_risk(lines(spark, sf), LINE_ORDER, "[ßÄÖÜ]", "xxx", ["license", "%%%"])


@query("agg23_stream_risk", with_(LN, RISK) + "SELECT * FROM rk")
def agg23(spark, sf):
    return risk(spark, sf)


@query("agg24_offset_consistency", with_(EV) + f""",
sc AS (SELECT stream_id, start_ms // {DAY} AS scene, CASE WHEN min(k) % 3 = 0 THEN NULL ELSE min(k) * 40 END AS off FROM ev GROUP BY ALL),
md AS (SELECT stream_id, list(off ORDER BY off)[CAST(count(off) // 2 + 1 AS INT)] AS m FROM sc WHERE off IS NOT NULL GROUP BY stream_id)
SELECT stream_id, count(*) AS scenes, count(off) AS anchored, count(*) FILTER (abs(off - m) <= 800) AS consistent, max(m) AS median_ms, round(CAST(count(off) AS DOUBLE) / count(*), 6) AS coverage,
  CASE WHEN count(off) = 0 THEN 'no_anchor' WHEN count(off) = count(*) FILTER (abs(off - m) <= 800) THEN 'consistent' ELSE 'inconsistent' END AS status
FROM sc LEFT JOIN md USING (stream_id) GROUP BY stream_id""")
def agg24(spark, sf):
    ev = events(spark, sf)
    scenes = ev.groupBy("stream_id", F.floor(F.col("start_ms") / DAY).alias("scene")).agg(F.min("k").alias("k"))
    pairs = scenes.select("stream_id", "scene", F.when(F.col("k") % 3 != 0, F.col("k") * 40).alias("offset_ms"))
    return ru.offset_consistency(pairs, tolerance_ms=800).withColumn("coverage", rounded("coverage", 6))


@query("agg24_row_coverage", with_(EV) + f""",
sc AS (SELECT stream_id, start_ms // {DAY} AS scene, CASE WHEN min(k) % 3 = 0 THEN NULL ELSE min(k) * 40 END AS off, count(*) AS n, min(k) % 4 AS prof, min(k) % 7 / 10.0 AS sim FROM ev GROUP BY ALL),
md AS (SELECT stream_id, list(off ORDER BY off)[CAST(count(off) // 2 + 1 AS INT)] AS m FROM sc WHERE off IS NOT NULL GROUP BY stream_id),
g AS (SELECT stream_id, CAST(sum(CASE WHEN off IS NOT NULL AND prof > 0 AND abs(off - m) <= 800 THEN n ELSE 0 END) AS BIGINT) AS mapped_rows, CAST(sum(n) AS BIGINT) AS total_rows, count(off) AS candidates,
  count(*) FILTER (off IS NOT NULL AND prof > 0 AND sim >= 0.2) AS compatible_scenes, max(m) AS median_ms, avg(CASE WHEN off IS NOT NULL THEN CAST(sim AS DOUBLE) END) AS mean FROM sc LEFT JOIN md USING (stream_id) GROUP BY stream_id)
SELECT stream_id, mapped_rows, total_rows, candidates, compatible_scenes, median_ms, round(CAST(mapped_rows AS DOUBLE) / greatest(total_rows, 1), 6) AS coverage, round(coalesce(mean, 0), 6) AS mean_similarity,
  CASE WHEN candidates = 0 THEN 'text-only' WHEN mapped_rows > 0 THEN 'machine-aligned' ELSE 'machine-aligned-low-confidence' END AS status FROM g""")
def agg24c(spark, sf):
    ev = events(spark, sf)
    scenes = ev.groupBy("stream_id", F.floor(F.col("start_ms") / DAY).alias("scene")).agg(F.min("k").alias("k"), F.count("*").alias("n_rows"))
    scenes = scenes.select("stream_id", "scene", F.when(F.col("k") % 3 != 0, F.col("k") * 40).alias("offset_ms"), "n_rows", (F.col("k") % 4).alias("profiles"), (F.col("k") % 7 / 10.0).alias("best_similarity"))
    return ru.row_coverage(scenes, tolerance_ms=800).withColumns({"coverage": rounded("coverage", 6), "mean_similarity": rounded("mean_similarity", 6)})


@query("agg4_witness_similarity", with_(TN) + f""",
tr AS (SELECT stream_id, seq, f.family, CASE WHEN p.part = 1 THEN substr(text, 1, 40) ELSE substr(text, 41, f.n) END AS t, p.part, seq % 5 <> 0 OR f.family <> 'beta' AS fits
  FROM tn, (VALUES ('alpha', 80), ('beta', 20), ('gamma', 0)) f(family, n), (VALUES (1), (2)) p(part) WHERE seq % 7 <> 3 AND (seq % 3 <> 0 OR f.family <> 'gamma')),
fam AS (SELECT stream_id, seq, family, {sql_key("string_agg(t, ' ' ORDER BY part)")} AS k, bool_and(fits) AS fits FROM tr GROUP BY stream_id, seq, family),
ok AS (SELECT stream_id, seq FROM fam GROUP BY ALL HAVING bool_and(fits)),
own AS (SELECT f.stream_id, f.seq, max({sql_jaccard('s.k', 'f.k')}) AS s FROM fam f SEMI JOIN ok USING (stream_id, seq) JOIN (SELECT stream_id, seq, {sql_key('text')} AS k FROM tn) s USING (stream_id, seq) GROUP BY ALL),
oth AS (SELECT a.stream_id, a.seq, max({sql_jaccard('a.k', 'b.k')}) AS a FROM fam a JOIN fam b ON a.stream_id = b.stream_id AND a.seq = b.seq AND a.family < b.family GROUP BY ALL)
SELECT stream_id, seq, round(s, 4) AS source_similarity, round(a, 4) AS family_agreement FROM own LEFT JOIN oth USING (stream_id, seq)""")
def agg4c(spark, sf):
    rows = turns(spark, sf)
    family = F.explode(F.array(*[F.struct(L(f).alias("family"), L(n).alias("n")) for f, n in (("alpha", 80), ("beta", 20), ("gamma", 0))]))
    said = rows.where("seq % 7 <> 3").select("stream_id", "seq", "text", family.alias("f")).where("seq % 3 <> 0 or f.family <> 'gamma'")
    said = said.withColumn("part", F.explode(F.array(L(1), L(2)))).withColumn("fits", (F.col("seq") % 5 != 0) | (F.col("f.family") != "beta"))
    text = F.when(F.col("part") == 1, F.substring("text", 1, 40)).otherwise(F.substr("text", L(41), F.col("f.n")))
    return ru.witness_similarity(rows, said.select("stream_id", "seq", "f.family", "part", text.alias("text"), F.col("fits").alias("block_aligned")))


@query("agg24_anchor_bands", with_(EV) + f"""
SELECT stream_id, count(*) FILTER (p <= 0.34) AS early, count(*) FILTER (p > 0.34 AND p < 0.67) AS middle, count(*) FILTER (p >= 0.67) AS late,
 count(*) FILTER (p <= 0.34) > 0 AND count(*) FILTER (p > 0.34 AND p < 0.67) > 0 AND count(*) FILTER (p >= 0.67) > 0 AS all_bands
FROM (SELECT stream_id, CAST(start_ms AS DOUBLE) / {MONTH} AS p FROM ev) GROUP BY stream_id""")
def agg24b(spark, sf):
    ev = events(spark, sf)
    d = ev.select("stream_id").distinct().withColumn("duration_ms", L(MONTH).cast("long"))
    return ru.anchor_bands(ev.select("stream_id", F.col("start_ms").alias("at_ms")), d)


@query("agg25_timeline_verdict", with_(EV) + """,
an AS (SELECT stream_id, count(*) AS anchors, min(o) AS low, max(o) AS high, max(abs(o)) AS worst FROM (
   SELECT stream_id, CASE WHEN stream_id % 3 = 0 THEN k % 4 * 100 WHEN stream_id % 3 = 1 THEN 5000 + k % 5 * 100 ELSE k * 50 END AS o FROM ev WHERE family = 'signup') GROUP BY stream_id),
md AS (SELECT stream_id, max(end_ms) - CASE WHEN stream_id % 10 = 9 THEN 1 ELSE 0 END AS ml, max(end_ms) AS tl FROM ev GROUP BY stream_id)
SELECT stream_id, coalesce(anchors, 0) AS anchors, CASE WHEN ml < tl THEN 'media_too_short' WHEN coalesce(anchors, 0) < 3 THEN 'unresolved' WHEN high - low <= 500 AND worst <= 500 THEN 'exact'
  WHEN high - low <= 500 THEN 'constant_offset' ELSE 'drift' END AS verdict,
  ml >= tl AND coalesce(anchors, 0) >= 3 AND coalesce(high - low <= 500 AND NOT worst <= 500, false) AS needs_approval FROM md LEFT JOIN an USING (stream_id)""")
def agg25(spark, sf):
    ev = events(spark, sf)
    third = F.col("stream_id") % 3
    off = F.when(third == 0, F.col("k") % 4 * 100).when(third == 1, 5000 + F.col("k") % 5 * 100).otherwise(F.col("k") * 50)
    anchors = ev.where("family = 'signup'").select("stream_id", F.col("start_ms").alias("text_ms"), (F.col("start_ms") + off).alias("media_ms"))
    media = ev.groupBy("stream_id").agg(F.max("end_ms").alias("text_len_ms"))
    media = media.withColumn("media_len_ms", F.col("text_len_ms") - F.when(F.col("stream_id") % 10 == 9, 1).otherwise(0))
    return ru.timeline_verdict(anchors, media).select("stream_id", "anchors", "verdict", "needs_approval")


@query("agg25_anchor_rows", with_(EV) + """
SELECT stream_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_ms, end_ms, seq) - 1 AS p, count(*) OVER (PARTITION BY stream_id) AS n FROM ev)
WHERE p IN (least(n - 1, n * 10 // 100), least(n - 1, n * 50 // 100), least(n - 1, n * 90 // 100))""")
def agg25b(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    return ru.anchor_rows(ev, order).select("stream_id", "seq")


def sql_pairs(src: str, out: str) -> str:
    return f"""{out}_t AS (SELECT stream_id, string_agg({sql_compact('text')}, '' ORDER BY start_ms, end_ms, seq) AS t, CAST(sum(end_ms - start_ms) AS BIGINT) AS shown FROM {src} GROUP BY stream_id),
{out}_g AS (SELECT stream_id, t, shown, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g FROM {out}_t)"""


@query("agg26_corpus_comparison", with_(EV, SIDES, sql_pairs("a", "x"), sql_pairs("b", "y"), """j AS (SELECT x.stream_id, len(list_intersect(x.g, y.g)) AS common, len(x.g) AS left_pairs, len(y.g) AS right_pairs,
  len(list_distinct(list_concat(x.g, y.g))) AS all_pairs, x.shown AS ls, y.shown AS rs, length(x.t) AS lc, length(y.t) AS rc FROM x_g x JOIN y_g y USING (stream_id))""") + """
SELECT stream_id, common, left_pairs, right_pairs, ls AS left_shown_ms, rs AS right_shown_ms, round(CAST(common AS DOUBLE) / all_pairs, 6) AS jaccard, round(CAST(common AS DOUBLE) / right_pairs, 6) AS coverage,
  round(CAST(common AS DOUBLE) / left_pairs, 6) AS precision, round(CAST(lc AS DOUBLE) / rc, 6) AS length_ratio FROM j""")
def agg26(spark, sf):
    ev, order = chunked_events(events(spark, sf))
    out = ru.corpus_comparison(family(ev, *LEFT), family(ev, *RIGHT), order)
    return out.select(
        "stream_id", "common", "left_pairs", "right_pairs", "left_shown_ms", "right_shown_ms",
        *[rounded(c, 6).alias(c) for c in ("jaccard", "coverage", "precision", "length_ratio")],
    )


@query("agg32_readiness", """WITH c AS (SELECT user_id AS stream_id, bool_or(event_type = 'signup') AS has_signup, bool_or(event_type = 'purchase' AND value > 100) AS has_purchase, bool_or(event_type = 'error' AND value > 120) AS has_error FROM events GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN NOT has_signup THEN 'signup' END, CASE WHEN NOT has_purchase THEN 'purchase' END, CASE WHEN NOT has_error THEN 'error' END], lambda x: x IS NOT NULL), ',') AS missing,
  has_signup AND has_purchase AND has_error AS ready FROM c""")
def agg32(spark, sf):
    role = F.when(F.col("event_type") == "signup", "signup").when((F.col("event_type") == "purchase") & (F.col("value") > 100), "purchase").when(
        (F.col("event_type") == "error") & (F.col("value") > 120), "error")
    files = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), role.alias("role"))
    return ru.readiness(files, ("signup", "purchase", "error")).withColumn("missing", F.array_join("missing", ","))
