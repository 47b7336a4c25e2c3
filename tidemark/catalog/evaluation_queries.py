"""Evaluation, sampling and queue queries on orders, labels, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.frames import DAY, EV, LINE_ORDER, LN, MONTH, chunked_events, events, lines, table, with_
from tidemark.catalog.audit_queries import ISSUES, RULES
from tidemark.catalog.evidence_queries import LEDGER, ledger_frames
from tidemark.catalog.overlay_queries import OR, rows as order_rows
from tidemark.catalog.registry import query
from tidemark.catalog.rollup_queries import QUALITY, RISK, RUNS, quality_rows, risk
from tidemark.functions.numbers import rounded
from tidemark.operators import audits as au
from tidemark.operators import evaluation as el
from tidemark.operators import evidence as ev_
from tidemark.operators import sampling as sm
from tidemark.operators.ordered import Order, chunked, position
from tidemark.session import materialise

L = F.lit


def seq():
    return F.col("seq")


# --- samples ---------------------------------------------------------------------------------

POS = """ps AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS pn, CASE WHEN seq % 3 = 0 THEN 'trusted' WHEN status = 'P' THEN 'suspect' ELSE 'unusable' END AS quality FROM b)"""


def placed(spark, sf):
    base, order = order_rows(spark, sf)
    q = F.when(seq() % 3 == 0, "trusted").when(F.col("status") == "P", "suspect").otherwise("unusable")
    return position(base, order, "at").withColumn("quality", q)


@query("smp2_stratified_rounds", with_(OR, POS) + """,
st AS (SELECT *, least(2, (pn - 1) * 3 // greatest(1, count(*) OVER (PARTITION BY stream_id))) AS band FROM ps),
h AS (SELECT *, sha256('s1|' || stream_id || '|' || quality || '|' || CAST(band AS BIGINT) || '|' || pn) AS h FROM st),
t AS (SELECT *, row_number() OVER (PARTITION BY stream_id, quality, band ORDER BY h, pn) AS turn FROM h)
SELECT stream_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY turn, quality, band) AS r FROM t) WHERE r <= 5""")
def smp2(spark, sf):
    return sm.stratified_rounds(placed(spark, sf), "s1", 5, at="at").select("stream_id", "seq")


@query("smp3_quota_sample", with_(EV) + """,
c AS (SELECT *, CASE WHEN k % 10 < 2 THEN 0 WHEN k % 10 = 3 THEN 1 ELSE 2 END AS c, sha256('q|' || stream_id || '|' || seq) AS h FROM ev),
i AS (SELECT *, row_number() OVER (PARTITION BY stream_id, c ORDER BY h, seq) AS i FROM c),
j AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY c, i) AS pick FROM i WHERE i <= CASE WHEN c < 2 THEN 6 ELSE 20 END)
SELECT stream_id, seq, pick, ['warning', 'gap', 'baseline'][c + 1] AS picked_for FROM j WHERE pick <= 20""")
def smp3(spark, sf):
    return quota(spark, sf).select("stream_id", "seq", F.col("pick").cast("long").alias("pick"), "picked_for")


def quota(spark, sf):
    cat = F.when(F.col("k") % 10 < 2, "warning").when(F.col("k") % 10 == 3, "gap")
    return sm.quota_sample(events(spark, sf).withColumn("category", cat), ["warning", "gap"], "q", 6, 20)


@query("smp3_distinct_starts")
def smp3b(spark, sf):
    picks = quota(spark, sf).select("stream_id", "seq", "pick", (F.floor(F.col("start_ms") / (6 * DAY)) * 6 * DAY).cast("long").alias("start_ms"), L(MONTH).cast("long").alias("limit_ms"))
    return sm.distinct_starts(picks).select("stream_id", "seq", "unique_start")


@query("smp4_bernoulli_audit", with_(OR) + """,
h AS (SELECT *, sha256('a7|' || stream_id || '|' || seq) AS h FROM b WHERE text IN ('3-MEDIUM', '5-LOW'))
SELECT stream_id, seq, CAST(0.1 AS DOUBLE) AS selection_probability, 'unreviewed' AS review_result FROM (SELECT *, min(h) OVER (PARTITION BY stream_id) AS f FROM h)
WHERE h = f OR CAST(('0x' || substr(h, 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.1""")
def smp4(spark, sf):
    base, _ = order_rows(spark, sf)
    out = sm.bernoulli_audit(base.withColumn("band", F.col("text")), "a7", 0.1, ("3-MEDIUM", "5-LOW"))
    return out.select("stream_id", "seq", "selection_probability", "review_result")


BLIND = """bl AS (SELECT *, CAST('0x' || substr(sha256(CAST(stream_id AS VARCHAR) || chr(0) || 'blind' || chr(0) || seq), 1, 2) AS INT) % 2 = 0 AS ev FROM b)"""


def pack(spark, sf):
    base, _ = order_rows(spark, sf)
    df = base.withColumns({"baseline": F.concat(L("b"), seq().cast("string")), "improvement": F.concat(L("i"), seq().cast("string"))})
    return sm.blind_pack(df, "blind", "baseline", "improvement")


@query("smp5_blind_public", with_(OR, BLIND) + "SELECT stream_id, seq, CASE WHEN ev THEN 'b' || seq ELSE 'i' || seq END AS candidate_a, CASE WHEN ev THEN 'i' || seq ELSE 'b' || seq END AS candidate_b FROM bl")
def smp5a(spark, sf):
    return pack(spark, sf)[0]


@query("smp5_blind_key", with_(OR, BLIND) + "SELECT stream_id, seq, CASE WHEN ev THEN 'baseline' ELSE 'improvement' END AS candidate_a_variant, CASE WHEN ev THEN 'improvement' ELSE 'baseline' END AS candidate_b_variant FROM bl")
def smp5b(spark, sf):
    return pack(spark, sf)[1]


@query("smp5_blind_three", with_(OR) + """,
v AS (SELECT stream_id, seq, list_sort([{'h': sha256('three' || chr(0) || stream_id || chr(0) || seq || chr(0) || 'x'), 'v': 'x'}, {'h': sha256('three' || chr(0) || stream_id || chr(0) || seq || chr(0) || 'y'), 'v': 'y'},
  {'h': sha256('three' || chr(0) || stream_id || chr(0) || seq || chr(0) || 'z'), 'v': 'z'}]) AS l FROM b)
SELECT stream_id, seq, l[1].v AS candidate_a_variant, l[2].v AS candidate_b_variant, l[3].v AS candidate_c_variant FROM v""")
def smp5c(spark, sf):
    base, _ = order_rows(spark, sf)
    return sm.blind_three(base, "three", ["x", "y", "z"])


COMMIT = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("smp5_commitment", with_(OR, BLIND) + f""",
r AS (SELECT stream_id, sha256(CAST(seq AS VARCHAR) || chr(0) || CASE WHEN ev THEN 'baseline' ELSE 'improvement' END) AS h FROM bl)
SELECT stream_id, count(*) AS n_rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {COMMIT})) AS commitment FROM r GROUP BY stream_id""")
def smp5d(spark, sf):
    return sm.commitment(pack(spark, sf)[1], ["seq", "candidate_a_variant"])


# --- queues ----------------------------------------------------------------------------------


DECIDED = """dc AS (SELECT o_custkey AS stream_id, o_orderkey AS seq, o_orderkey AS k, ['accepted', ' Abstained', 'hold', 'accepted'][o_orderkey % 4 + 1] AS status, ['high', 'LOW', '', 'medium', 'unknown'][o_orderkey % 5 + 1] AS confidence,
  CASE WHEN o_orderkey % 6 = 0 THEN ['actor', 'target'] ELSE [] END AS slots, CASE WHEN o_orderkey % 7 = 0 THEN ['r' || CAST(o_orderkey % 3 AS VARCHAR)] END AS risks,
  CASE o_orderkey % 9 WHEN 0 THEN [] WHEN 1 THEN NULL ELSE ['e' || CAST(o_orderkey % 5 AS VARCHAR), 'e' || CAST(o_orderkey % 3 AS VARCHAR)] END AS refs FROM orders)"""
TOLD = "SELECT DISTINCT stream_id, seq, r.p AS priority, r.c AS code, r.d AS detail FROM (SELECT stream_id, seq, unnest([{}]) AS r FROM {}) WHERE r IS NOT NULL"


def told_sql(source, *found):
    return TOLD.format(", ".join(f"CASE WHEN {when} THEN {{'p': {p}, 'c': '{code}', 'd': {detail}}} END" for when, p, code, detail in found), source)


def decided(spark, sf):
    k = F.col("o_orderkey")
    nth = lambda words, n: F.get(F.array(*map(L, words)), (k % n).cast("int"))
    tag = lambda letter, n: F.concat(L(letter), (k % n).cast("string"))
    none = F.array().cast("array<string>")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("stream_id"), k.alias("seq"), nth(["accepted", " Abstained", "hold", "accepted"], 4).alias("status"),
        nth(["high", "LOW", "", "medium", "unknown"], 5).alias("confidence"), F.when(k % 6 == 0, F.array(L("actor"), L("target"))).otherwise(none).alias("uncertain_slots"),
        F.when(k % 7 == 0, F.array(tag("r", 3))).alias("risk_codes"), F.when(k % 9 == 0, none).when(k % 9 != 1, F.array(tag("e", 5), tag("e", 3))).alias("evidence_refs"),
    )


REASONED = told_sql("dc", ("lower(trim(status)) IN ('abstained', 'hold')", "'critical'", "decision-status", "lower(trim(status))"),
    ("lower(confidence) IN ('', 'low', 'unknown')", "'high'", "low-evidence-strength", "CASE WHEN confidence = '' THEN 'missing' ELSE lower(confidence) END"),
    ("len(slots) > 0", "'high'", "uncertain-slots", "'actor, target'"), ("risks IS NOT NULL", "'high'", "unresolved-risk-or-alternative", "risks[1]"),
    ("refs IS NULL OR len(refs) = 0", "'high'", "missing-evidence-refs", "CAST(NULL AS VARCHAR)"))


@query("top1_reasons_of_decisions", with_(DECIDED) + REASONED)
def top1_decisions(spark, sf):
    return sm.decision_reasons(decided(spark, sf))


CONTRACT = "ct AS (SELECT *, CASE WHEN k % 8 <> 0 AND k % 10 <> 0 THEN ['e0', 'e1', 'e2'] ELSE [] END AS allowed FROM dc),\nst AS (SELECT *, list_sort(list_filter(list_distinct(refs), lambda x: NOT list_contains(allowed, x))) AS stray FROM ct)"
REFS = told_sql("st", ("len(allowed) = 0", "'high'", "queue-evidence-contract", "CAST(NULL AS VARCHAR)"), ("len(allowed) > 0 AND len(stray) > 0", "'high'", "unmapped-evidence-ref", "array_to_string(stray, ', ')"))


@query("top1_reasons_of_refs", with_(DECIDED, CONTRACT) + REFS)
def top1_refs(spark, sf):
    rows = decided(spark, sf)
    refs = F.when(F.col("seq") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(L("e0"), L("e1"), L("e2")))
    return sm.ref_reasons(rows, rows, rows.where("seq % 8 <> 0").select("stream_id", "seq", refs.alias("evidence_refs")))


@query("top1_reasons_of_consistency", with_(LEDGER) + """,
us AS (SELECT h.*, CASE WHEN status = 'confirmed' THEN CASE WHEN c.key IS NULL THEN 'applied' ELSE 'withheld_conflict' END ELSE 'unresolved' END AS use
FROM hit h LEFT JOIN cf c ON h.stream_id = c.stream_id AND h.seq = c.seq AND h.entry_type = c.entry_type AND h.scope = c.scope AND h.key = c.key AND h.speaker_id = c.speaker_id AND h.addressee_id = c.addressee_id WHERE status <> 'retired')
SELECT stream_id, seq, 'high' AS priority, 'consistency-conflict' AS code, entry_type || ':' || string_agg(DISTINCT CAST(entry_id AS VARCHAR), ',' ORDER BY CAST(entry_id AS VARCHAR)) AS detail FROM us WHERE use = 'withheld_conflict' GROUP BY stream_id, seq, entry_type, scope, key
UNION ALL SELECT DISTINCT stream_id, seq, CASE entry_type WHEN 'tone' THEN 'high' ELSE 'medium' END, 'consistency-unresolved', entry_type || ':' || CAST(entry_id AS VARCHAR) FROM us WHERE use = 'unresolved'""")
def top1_consistency(spark, sf):
    applied, classes = ev_.ledger_classes(*ledger_frames(spark, sf))
    return ev_.spread(materialise(sm.consistency_reasons(applied, weighty=("tone",)), "reasons"), classes)


BANDED = told_sql("bd", ("band = 'P1'", "'high'", "prior-p1", "band"), ("band = 'P2'", "'medium'", "prior-p2", "band"), ("confidence = 'low'", "'high'", "prior-low-confidence", "'low'"),
    ("confidence = 'medium'", "'medium'", "prior-medium-confidence", "'medium'"), ("scope <> ''", "'high'", "prior-uncertain-scope", "scope"))


@query("top1_reasons_of_bands", "WITH bd AS (SELECT l_orderkey AS stream_id, l_linenumber AS seq, 'P' || CAST(l_partkey % 4 + 1 AS VARCHAR) AS band, ['low', 'medium', 'high'][l_suppkey % 3 + 1] AS confidence, CASE WHEN l_partkey % 5 = 0 THEN 'actor' ELSE '' END AS scope FROM lineitem)\n" + BANDED)
def top1_bands(spark, sf):
    prior = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").alias("seq"), F.concat(L("P"), (F.col("l_partkey") % 4 + 1).cast("string")).alias("band"),
        F.get(F.array(L("LOW "), L("medium"), L("high")), (F.col("l_suppkey") % 3).cast("int")).alias("confidence"), F.when(F.col("l_partkey") % 5 == 0, " actor").alias("uncertain_scope"),
    )
    return sm.band_reasons(prior)


@query("top1_queue_of_all_reasons", with_(LN, ISSUES, DECIDED, CONTRACT) + f""",
rs AS ({REASONED} UNION ALL {REFS} UNION ALL SELECT DISTINCT stream_id, seq, CASE severity WHEN 'error' THEN 'critical' ELSE 'medium' END, 'faithful:' || code, severity FROM iss WHERE seq IS NOT NULL),
pr AS (SELECT *, CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS p FROM rs),
g AS (SELECT stream_id, seq, min(p) AS p, array_to_string(list_transform(list_sort(list_distinct(list({{'p': p, 'code': code}}))), lambda x: x.code), ',') AS reason_codes FROM pr GROUP BY ALL)
SELECT stream_id, seq, row_number() OVER (PARTITION BY stream_id ORDER BY p, seq) AS rank, ['critical', 'high', 'medium'][p] AS priority, reason_codes FROM g""")
def top1_all(spark, sf):
    rows = decided(spark, sf)
    refs = F.when(F.col("seq") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(L("e0"), L("e1"), L("e2")))
    contract = rows.where("seq % 8 <> 0").select("stream_id", "seq", refs.alias("evidence_refs"))
    issues = au.segment_issues(lines(spark, sf), LINE_ORDER, RULES).withColumn("variant", L("faithful"))
    queue = sm.review_queue([sm.decision_reasons(rows), sm.ref_reasons(rows, rows, contract), sm.issue_reasons(issues)])
    return queue.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("agg18_release_gate", """WITH s AS (SELECT c_custkey AS k FROM customer),
c AS (SELECT k, k % 5 <> 0 AND k % 7 <> 3 AND k % 2 = 0 AS adjudicated_gold, k % 3 <> 0 AND k % 4 <> 1 AS blind_human_review, k % 6 <> 0 AND k % 10 <> 0 AS p3_p4_audit, k % 8 <> 0 AS measured_review_efficiency, k % 9 <> 0 AND k % 11 <> 0 AS human_release_approval, true AS sol_experiment FROM s),
m AS (SELECT *, list_filter([CASE WHEN NOT adjudicated_gold THEN 'adjudicated_gold' END, CASE WHEN NOT blind_human_review THEN 'blind_human_review' END, CASE WHEN NOT p3_p4_audit THEN 'p3_p4_audit' END,
  CASE WHEN NOT measured_review_efficiency THEN 'measured_review_efficiency' END, CASE WHEN NOT human_release_approval THEN 'human_release_approval' END], lambda x: x IS NOT NULL) AS missing FROM c)
SELECT k AS stream_id, CASE WHEN len(missing) = 0 THEN 'pass' ELSE 'fail' END AS status, array_to_string(missing, ',') AS missing FROM m""")
def agg18c(spark, sf):
    """Some streams lack a row, a count, a name or have a row that fails beside one that passes."""
    k = F.col("stream_id")
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("stream_id"))
    gold = s.where("stream_id % 5 <> 0").select("stream_id", L("pass").alias("status"), (k % 7 - 3).alias("adjudicated_records"), (1 - k % 2).alias("locked_test_records"))
    gold = gold.withColumn("adjudicated_records", F.abs("adjudicated_records"))
    blind = s.select("stream_id", F.when(k % 3 != 0, "human-reviewed").alias("evaluation_status"), L(True).alias("review_complete"), F.when(k % 4 != 1, 5).alias("reviewed_blocks"))
    audit = s.select("stream_id", (k % 6 != 0).alias("review_complete"), L(3).alias("reviewed_blocks"))
    audit = audit.unionByName(s.where("stream_id % 10 = 0").select("stream_id", L(True).alias("review_complete"), L(0).alias("reviewed_blocks")))
    metrics = s.select("stream_id", F.when(k % 8 != 0, "demonstrated").otherwise("withheld").alias("metrics_status"))
    approval = s.select("stream_id", (k % 9 != 0).alias("approved"), F.when(k % 11 == 0, " ").otherwise("someone").alias("approved_by"))
    out = el.release_gate(s, {"gold_suite": gold, "blind_review": blind, "audit_summary": audit, "review_metrics": metrics, "release_approval": approval})
    return out.select("stream_id", "status", F.array_join("missing", ",").alias("missing"))


@query("top1_review_queue", with_(LN, ISSUES) + """,
rs AS (SELECT stream_id, seq, CASE WHEN severity = 'error' THEN 1 ELSE 3 END AS p, code FROM iss WHERE seq IS NOT NULL UNION ALL SELECT stream_id, seq, 2, 'long_text' FROM ln WHERE length(text) > 300),
g AS (SELECT stream_id, seq, min(p) AS p, array_to_string(list_transform(list_sort(list_distinct(list({'p': p, 'code': code}))), lambda x: x.code), ',') AS reason_codes FROM rs GROUP BY ALL)
SELECT stream_id, seq, row_number() OVER (PARTITION BY stream_id ORDER BY p, seq) AS rank, ['critical', 'high', 'medium'][p] AS priority, reason_codes FROM g""")
def top1(spark, sf):
    return queue(spark, sf).withColumn("reason_codes", F.array_join("reason_codes", ","))


def queue(spark, sf):
    rows = lines(spark, sf)
    issues = au.segment_issues(rows, LINE_ORDER, RULES).where("seq is not null")
    first = issues.select("stream_id", "seq", F.when(F.col("severity") == "error", "critical").otherwise("medium").alias("priority"), "code")
    second = rows.where(F.length("text") > 300).select("stream_id", "seq", L("high").alias("priority"), L("long_text").alias("code"))
    return sm.review_queue([first, second])


@query("top2_ambiguous_first", with_(LN, RUNS, QUALITY) + """,
a AS (SELECT stream_id, seq, length(text) % 3 = 0 AS low, quality <> 'trusted' AS doubt FROM qq),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY low DESC, doubt DESC, seq) AS pick FROM a WHERE low OR doubt)
SELECT stream_id, seq, pick, array_to_string(list_filter([CASE WHEN low THEN 'low_confidence' END, CASE WHEN doubt THEN 'source_not_trusted' END], lambda x: x IS NOT NULL), ',') AS selection_reasons FROM r WHERE pick <= 4""")
def top2(spark, sf):
    rows = quality_rows(spark, sf).withColumn("confidence", F.when(F.length("text") % 3 == 0, "low").otherwise("high"))
    out = sm.ambiguous_first(rows, 4)
    return out.select("stream_id", "seq", F.col("pick").cast("long").alias("pick"), F.array_join("selection_reasons", ",").alias("selection_reasons"))


@query("review_queue_flagship", with_(LN, ISSUES) + ", " + RISK.replace("a AS (", "ra AS (").replace("b AS (SELECT *, lag(k)", "rb AS (SELECT *, lag(k)").replace("FROM a WINDOW", "FROM ra WINDOW").replace("FROM b GROUP BY stream_id)", "FROM rb GROUP BY stream_id)").replace("FROM a WHERE sem", "FROM ra WHERE sem") + """,
rs AS (SELECT stream_id, seq, CASE WHEN severity = 'error' THEN 1 ELSE 3 END AS p, code FROM iss WHERE seq IS NOT NULL UNION ALL SELECT stream_id, seq, 2, 'long_text' FROM ln WHERE length(text) > 300),
g AS (SELECT stream_id, seq, min(p) AS p, array_to_string(list_transform(list_sort(list_distinct(list({'p': p, 'code': code}))), lambda x: x.code), ',') AS reason_codes FROM rs GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY p, seq) AS rank FROM g)
SELECT q.stream_id, rk.risk_score, rk.segments, q.rank, q.seq, ['critical', 'high', 'medium'][p] AS priority, reason_codes FROM q JOIN rk USING (stream_id) WHERE rank <= 5""")
def flagship(spark, sf):
    scored = risk(spark, sf).select("stream_id", "risk_score", "segments")
    head = queue(spark, sf).where("rank <= 5")
    return scored.join(head, "stream_id").select(
        "stream_id", "risk_score", "segments", "rank", "seq", "priority", F.array_join("reason_codes", ",").alias("reason_codes"))


# --- budgets ---------------------------------------------------------------------------------

BUDGET = """ud AS (SELECT d.source AS universe, d.doc_id, l.quality, l.toxic, d.n_chars % 97 AS risk FROM documents d JOIN labels l USING (doc_id)),
rc AS (SELECT universe, CAST(doc_id AS VARCHAR) AS record_id, row_number() OVER (PARTITION BY universe ORDER BY -risk, doc_id) AS rank, CASE WHEN quality = 0 THEN 'error' ELSE 'no-error' END AS label,
  CASE WHEN quality = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'meaning' ELSE 'context' END END AS error_type, CASE WHEN toxic = 1 THEN 'critical' ELSE 'major' END AS severity FROM ud),
un AS (SELECT universe, count(*) AS n, count(*) FILTER (label = 'error') AS gp, count(*) FILTER (label = 'error' AND severity = 'critical') AS cp FROM rc GROUP BY universe),
bu AS (SELECT u.*, x.budget, least(n, CAST(ceil(n * x.budget / 100) AS BIGINT)) AS k, CASE WHEN right(universe, 1) = '3' THEN gp + 1 ELSE gp END AS gold FROM un u, (SELECT unnest([5, 10, 20]) AS budget) x),
tp AS (SELECT b.universe, b.budget, count(*) FILTER (r.rank <= b.k AND label = 'error') AS tp, count(*) FILTER (r.rank <= b.k AND label = 'error' AND severity = 'critical') AS cr FROM bu b JOIN rc r USING (universe) GROUP BY ALL),
mt AS (SELECT *, CASE WHEN gold < 1 THEN 'gold_missing' WHEN gold <> gp THEN 'gold_does_not_reconcile' ELSE '' END AS reasons FROM bu JOIN tp USING (universe, budget))"""


def records(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    rows = rows.select(
        F.col("source").alias("universe"), "doc_id", F.when(F.col("quality") == 0, "error").otherwise("no-error").alias("label"),
        F.when(F.col("quality") == 0, F.when(F.col("doc_id") % 2 == 0, "meaning").otherwise("context")).alias("error_type"), F.when(F.col("toxic") == 1, "critical").otherwise("major").alias("severity"),
        (-(F.col("n_chars") % 97)).alias("neg_risk"),
    )
    # ranks by (risk, id): the chunk grows with that order
    rows = rows.withColumn("_chunk", (F.col("neg_risk") + 100) * 1_000_000 + F.floor(F.col("doc_id") / 100_000))
    ranked = position(rows, Order(("universe",), ("neg_risk", "doc_id"), "_chunk"), "rank")
    return ranked.withColumn("record_id", F.col("doc_id").cast("string"))


@query("agg13_budget_metrics", with_(BUDGET) + """
SELECT universe, budget, CASE WHEN reasons = '' THEN k END AS reviewed, CASE WHEN reasons = '' THEN tp END AS true_positive, CASE WHEN reasons = '' THEN k - tp END AS false_positive, CASE WHEN reasons = '' THEN gold - tp END AS false_negative,
  round(CASE WHEN reasons = '' THEN CAST(tp AS DOUBLE) / gold END, 6) AS recall, round(CASE WHEN reasons = '' THEN CAST(tp AS DOUBLE) / k END, 6) AS precision, round(CASE WHEN reasons = '' AND cp > 0 THEN CAST(cr AS DOUBLE) / cp END, 6) AS critical_recall, reasons FROM mt""")
def agg13(spark, sf):
    rec = records(spark, sf)
    gold = rec.groupBy("universe").agg(F.count(F.when(F.col("label") == "error", 1)).alias("gold_positives"))
    gold = gold.withColumn("gold_positives", F.col("gold_positives") + F.when(F.col("universe").endswith("3"), 1).otherwise(0))
    out = el.budget_metrics(rec, gold)
    return out.withColumns({**{c: rounded(c, 6) for c in ("recall", "precision", "critical_recall")}, "reasons": F.array_join("reasons", ",")})


@query("agg13_budget_type_recall", with_(BUDGET) + """
SELECT b.universe, error_type, count(*) AS gold, b.budget, count(*) FILTER (r.rank <= b.k) AS found, round(CAST(count(*) FILTER (r.rank <= b.k) AS DOUBLE) / count(*), 6) AS recall FROM bu b JOIN rc r USING (universe) WHERE label = 'error' GROUP BY ALL""")
def agg13b(spark, sf):
    return el.budget_type_recall(records(spark, sf)).withColumn("recall", rounded("recall", 6))


# --- reviewed rows and their errors ------------------------------------------------------------

REVIEW = """rv AS (SELECT o_custkey % 40 AS stream_id, o_orderkey AS seq, CASE WHEN o_custkey % 40 = 7 AND o_orderkey % 3 = 0 THEN 'pending' WHEN o_custkey % 40 = 9 AND o_orderkey % 5 = 0 THEN 'unresolved' ELSE 'agreed' END AS st,
   CASE WHEN o_custkey % 40 = 9 AND o_orderkey % 5 = 0 THEN 'unresolved' WHEN o_orderkey % 19 = 0 THEN 'nonverbal' WHEN o_orderstatus = 'F' THEN 'improvement' WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'baseline' WHEN o_custkey % 4 = 1 THEN 'improvement' ELSE 'tie' END AS outcome FROM orders),
er AS (SELECT o_custkey % 40 AS stream_id, l_orderkey AS seq, CASE l_returnflag WHEN 'A' THEN 'baseline' WHEN 'R' THEN 'improvement' ELSE 'other' END AS candidate, CASE WHEN l_partkey % 3 = 0 THEN 'fluency' WHEN l_partkey % 3 = 1 THEN 'semantic_fidelity' ELSE 'context' END AS dimension,
   CASE WHEN l_quantity > 40 AND (l_returnflag = 'A' OR o_custkey % 2 = 0) THEN 'critical' WHEN l_quantity > 30 AND l_returnflag = 'A' THEN 'major' ELSE 'minor' END AS severity, CASE WHEN l_suppkey % 2 = 0 THEN 'Added' ELSE 'omitted' END AS error_type, 'r' || CAST(l_suppkey % 2 AS VARCHAR) AS ref
   FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
cp AS (SELECT stream_id, count(*) AS n_rows, count(*) FILTER (st = 'pending') AS pending, count(*) FILTER (st = 'unresolved') AS unresolved FROM rv GROUP BY ALL),
sv AS (SELECT stream_id, seq, candidate, lower(error_type) AS t, ref FROM er WHERE dimension = 'semantic_fidelity' AND severity = 'critical'),
fr AS (SELECT s.stream_id, count(*) AS e, count(DISTINCT s.seq) AS r FROM sv s WHERE candidate = 'improvement' AND NOT EXISTS (SELECT 1 FROM sv b WHERE b.candidate = 'baseline' AND b.stream_id = s.stream_id AND b.seq = s.seq AND b.t = s.t AND b.ref = s.ref) GROUP BY ALL),
g15 AS (SELECT cp.*, CASE WHEN pending + unresolved = 0 THEN coalesce(e, 0) END AS new_errors, CASE WHEN pending + unresolved = 0 THEN coalesce(r, 0) END AS new_error_rows, CASE WHEN pending + unresolved > 0 THEN 'awaiting' WHEN coalesce(e, 0) = 0 THEN 'pass' ELSE 'fail' END AS status FROM cp LEFT JOIN fr USING (stream_id)),
bd AS (SELECT stream_id, count(DISTINCT CASE WHEN candidate = 'baseline' THEN seq END) AS b, count(DISTINCT CASE WHEN candidate = 'improvement' THEN seq END) AS i FROM er WHERE dimension IN ('semantic_fidelity', 'context') AND severity IN ('critical', 'major') GROUP BY ALL),
g16 AS (SELECT cp.*, CASE WHEN pending + unresolved = 0 THEN coalesce(b, 0) END AS baseline_rows, CASE WHEN pending + unresolved = 0 THEN coalesce(i, 0) END AS improvement_rows,
   round(CASE WHEN pending + unresolved = 0 AND coalesce(b, 0) > 0 THEN CAST(b - i AS DOUBLE) / b END, 6) AS reduction_rate, CASE WHEN pending > 0 THEN 'awaiting' WHEN unresolved > 0 OR coalesce(b, 0) = 0 THEN 'inconclusive' WHEN (b - i) * 100 >= b * 50 THEN 'pass' ELSE 'fail' END AS status FROM cp LEFT JOIN bd USING (stream_id)),
pf AS (SELECT stream_id, count(*) FILTER (outcome = 'improvement') AS w, count(*) FILTER (outcome = 'baseline') AS l, count(*) FILTER (outcome IN ('tie', 'nonverbal')) AS t FROM rv GROUP BY ALL),
g17 AS (SELECT cp.*, CASE WHEN pending = 0 THEN w END AS wins, CASE WHEN pending = 0 THEN l END AS losses, CASE WHEN pending = 0 THEN t END AS ties, round(CASE WHEN pending = 0 THEN CAST(w AS DOUBLE) / n_rows END, 6) AS win_rate, round(CASE WHEN pending = 0 THEN CAST(l AS DOUBLE) / n_rows END, 6) AS loss_rate,
   CASE WHEN pending > 0 THEN 'awaiting' WHEN unresolved > 0 THEN 'inconclusive' WHEN w * 100 >= n_rows * 40 AND l * 100 <= n_rows * 30 THEN 'pass' ELSE 'fail' END AS status FROM cp JOIN pf USING (stream_id))"""


def reviewed(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("stream_id"), F.col("o_orderkey").alias("seq"), "o_custkey", "o_orderstatus")
    st = F.when((F.col("stream_id") == 7) & (seq() % 3 == 0), "pending").when((F.col("stream_id") == 9) & (seq() % 5 == 0), "unresolved").otherwise("agreed")
    out = (
        F.when((F.col("stream_id") == 9) & (seq() % 5 == 0), "unresolved").when(seq() % 19 == 0, "nonverbal").when(F.col("o_orderstatus") == "F", "improvement")
        .when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 3 == 0), "baseline").when(F.col("o_custkey") % 4 == 1, "improvement").otherwise("tie")
    )
    rows = o.withColumns({"adjudication_status": st, "outcome": out})
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey", "l_quantity", "l_suppkey").join(o, F.col("l_orderkey") == F.col("seq"))
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    errors = li.select(
        "stream_id", "seq", F.when(flag == "A", "baseline").when(flag == "R", "improvement").otherwise("other").alias("candidate"),
        F.when(F.col("l_partkey") % 3 == 0, "fluency").when(F.col("l_partkey") % 3 == 1, "semantic_fidelity").otherwise("context").alias("dimension"),
        F.when((q > 40) & ((flag == "A") | (F.col("o_custkey") % 2 == 0)), "critical").when((q > 30) & (flag == "A"), "major").otherwise("minor").alias("severity"),
        F.when(F.col("l_suppkey") % 2 == 0, "Added").otherwise("omitted").alias("error_type"), F.array(F.concat(L("r"), (F.col("l_suppkey") % 2).cast("string"))).alias("refs"),
    )
    return rows, errors


@query("agg15_new_critical_errors", with_(REVIEW) + "SELECT * FROM g15")
def agg15(spark, sf):
    return el.new_critical_errors(*reviewed(spark, sf))


@query("agg16_error_row_reduction", with_(REVIEW) + "SELECT * FROM g16")
def agg16(spark, sf):
    return el.error_row_reduction(*reviewed(spark, sf)).withColumn("reduction_rate", rounded("reduction_rate", 6))


@query("agg17_fixed_preference", with_(REVIEW) + "SELECT * FROM g17")
def agg17(spark, sf):
    out = el.fixed_preference(reviewed(spark, sf)[0], win_pct=40, loss_pct=30)
    return out.withColumns({c: rounded(c, 6) for c in ("win_rate", "loss_rate")})


@query("agg18_combined_gate", with_(REVIEW) + """
SELECT stream_id, a.status AS new_errors, b.status AS reduction, c.status AS preference, CASE WHEN 'awaiting' IN (a.status, b.status, c.status) THEN 'awaiting' WHEN 'inconclusive' IN (a.status, b.status, c.status) THEN 'inconclusive' WHEN 'fail' IN (a.status, b.status, c.status) THEN 'fail' ELSE 'pass' END AS gate,
  array_to_string(list_filter([CASE WHEN a.status <> 'pass' THEN 'new_errors:' || a.status END, CASE WHEN b.status <> 'pass' THEN 'reduction:' || b.status END, CASE WHEN c.status <> 'pass' THEN 'preference:' || c.status END], lambda x: x IS NOT NULL), ',') AS blockers
FROM g15 a JOIN g16 b USING (stream_id) JOIN g17 c USING (stream_id)""")
def agg18(spark, sf):
    r, e = reviewed(spark, sf)
    out = el.combined_gate({"new_errors": el.new_critical_errors(r, e), "reduction": el.error_row_reduction(r, e), "preference": el.fixed_preference(r, win_pct=40, loss_pct=30)})
    return out.withColumn("blockers", F.array_join("blockers", ","))


@query("agg18_bundle_permissions", with_(OR) + """,
g AS (SELECT stream_id, bool_and(end_ms >= start_ms) AS a, count(*) >= 8 AS b, bool_or(status = 'F') AS c, max(seq) % 2 = 0 AS d FROM b GROUP BY stream_id)
SELECT stream_id, a AS may_stage, a AND b AS may_draft, a AND b AND c AS may_package, a AND b AND c AND d AS may_release FROM g""")
def agg18b(spark, sf):
    base, _ = order_rows(spark, sf)
    g = base.groupBy("stream_id").agg(
        F.bool_and(F.col("end_ms") >= F.col("start_ms")).alias("structure_ok"), (F.count("*") >= 8).alias("evidence_ok"), F.bool_or(F.col("status") == "F").alias("quality_ok"), (F.max("seq") % 2 == 0).alias("review_ok"))
    return el.bundle_permissions(g).select("stream_id", "may_stage", "may_draft", "may_package", "may_release")


Z = "1.959963984540054"


def wilson_sql(sign: str) -> str:
    p, n = "(CAST(wins AS DOUBLE) / nullif(wins + losses, 0))", "nullif(wins + losses, 0)"
    centre = f"({p} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n})"
    margin = f"{Z} * sqrt(({p} * (1 - {p}) + {Z} * {Z} / (4 * {n})) / {n}) / (1 + {Z} * {Z} / {n})"
    return f"least(1.0, {centre} + {margin})" if sign == "+" else f"greatest(0.0, {centre} - {margin})"


@query("agg14_pairwise_wilson", with_(REVIEW) + f""",
fl AS (SELECT r.stream_id, r.seq, outcome, coalesce(bool_or(candidate = 'improvement' AND severity = 'critical' AND dimension <> 'fluency'), false) AS cc, coalesce(bool_or(candidate = 'baseline' AND severity = 'critical' AND dimension <> 'fluency'), false) AS oc,
   coalesce(bool_or(candidate = 'improvement' AND severity = 'major' AND dimension <> 'fluency'), false) AS cm, coalesce(bool_or(candidate = 'baseline' AND severity = 'major' AND dimension <> 'fluency'), false) AS om, coalesce(bool_or(candidate = 'improvement' AND dimension <> 'fluency'), false) AS an
   FROM rv r LEFT JOIN er e ON e.stream_id = r.stream_id AND e.seq = r.seq GROUP BY ALL),
ag AS (SELECT stream_id, count(*) AS scenes, count(*) FILTER (NOT cc AND NOT oc) AS qualified, count(*) FILTER (NOT cc AND NOT oc AND outcome = 'improvement') AS wins, count(*) FILTER (NOT cc AND NOT oc AND outcome = 'baseline') AS losses,
   count(*) FILTER (NOT cc AND NOT oc AND outcome = 'tie') AS ties, count(*) FILTER (cc) AS c1, count(*) FILTER (oc) AS c2, count(*) FILTER (cm) AS c3, count(*) FILTER (om) AS c4, count(*) FILTER (an) AS c5 FROM fl GROUP BY ALL)
SELECT stream_id, scenes, qualified, wins, losses, ties, round(CAST(wins AS DOUBLE) / nullif(wins + losses, 0), 6) AS win_rate, round(CASE WHEN wins + losses > 0 THEN {wilson_sql('-')} END, 6) AS win_low, round(CASE WHEN wins + losses > 0 THEN {wilson_sql('+')} END, 6) AS win_high,
  round(CAST(losses AS DOUBLE) / nullif(qualified, 0), 6) AS loss_rate, round(CAST(ties AS DOUBLE) / nullif(qualified, 0), 6) AS tie_rate, round(CAST(c1 AS DOUBLE) / scenes, 6) AS candidate_critical_rate, round(CAST(c2 AS DOUBLE) / scenes, 6) AS comparator_critical_rate,
  round(CAST(c3 AS DOUBLE) / scenes, 6) AS candidate_major_rate, round(CAST(c4 AS DOUBLE) / scenes, 6) AS comparator_major_rate, round(CAST(c5 AS DOUBLE) / scenes, 6) AS semantic_error_rate FROM ag""")
def agg14(spark, sf):
    r, e = reviewed(spark, sf)
    issues = e.groupBy("stream_id", "seq").agg(F.collect_list(F.struct("candidate", "severity", (F.col("dimension") == "fluency").alias("uncertain"))).alias("issues"))
    scenes = r.join(issues, ["stream_id", "seq"], "left").withColumn("choice", F.col("outcome")).withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<candidate:string,severity:string,uncertain:boolean>>")))
    out = el.pairwise_metrics(scenes, "improvement", "baseline")
    return out.withColumns({c: rounded(c, 6) for c in out.columns if c.endswith("_rate") or c in ("win_low", "win_high")})


ADJ = """ky AS (SELECT o_custkey AS stream_id, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'improvement' END AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'improvement' ELSE 'baseline' END AS b FROM orders),
r1 AS (SELECT o_custkey AS stream_id, o_orderkey AS seq, CASE WHEN o_orderkey % 23 = 0 THEN 'unresolved' ELSE 'complete' END AS ds, ['both', 'a-only', 'b-only', 'neither'][o_orderkey % 4 + 1] AS sg, ['candidate-a', 'candidate-b', 'tie'][o_orderkey % 3 + 1] AS pr, o_orderkey % 17 = 0 AS nv FROM orders),
r2 AS (SELECT stream_id, seq, ds, CASE WHEN seq % 10 = 1 THEN 'neither' ELSE sg END AS sg, CASE WHEN seq % 7 = 0 THEN 'tie' ELSE pr END AS pr, nv FROM r1),
j AS (SELECT r1.*, ky.a, ky.b, r1.ds = r2.ds AND r1.sg = r2.sg AND r1.pr = r2.pr AND r1.nv = r2.nv AND r1.ds <> 'unresolved' AS same, r1.seq % 2 = 1 AS hasc, r1.seq % 6 <> 1 AS cok FROM r1 JOIN r2 USING (stream_id, seq) JOIN ky USING (stream_id, seq)),
f AS (SELECT *, CASE WHEN same THEN 'agreed' WHEN hasc AND cok THEN 'adjudicated' ELSE 'unresolved' END AS st, CASE WHEN same THEN sg WHEN hasc AND cok THEN 'a-only' END AS xg, CASE WHEN same THEN pr WHEN hasc AND cok THEN 'candidate-b' END AS xp, CASE WHEN same THEN nv WHEN hasc AND cok THEN false END AS xn FROM j)"""


@query("agg19_adjudication", with_(ADJ) + """
SELECT stream_id, seq, st AS adjudication_status, coalesce(CASE xg WHEN 'a-only' THEN a || '-only' WHEN 'b-only' THEN b || '-only' ELSE xg END, 'unresolved') AS semantic_gate, coalesce(CASE xp WHEN 'candidate-a' THEN a WHEN 'candidate-b' THEN b ELSE xp END, 'unresolved') AS preference,
  coalesce(CAST(xn AS VARCHAR), 'unresolved') AS nonverbal, same AND hasc AS stray_consensus FROM f""")
def agg19(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("seq"))

    def nth(words, n):
        return F.get(F.array(*[L(w) for w in words]), (seq() % n).cast("int"))

    first = o.withColumns({"decision_status": F.when(seq() % 23 == 0, "unresolved").otherwise("complete"), "semantic_gate": nth(["both", "a-only", "b-only", "neither"], 4),
                           "preference": nth(["candidate-a", "candidate-b", "tie"], 3), "nonverbal": seq() % 17 == 0})
    second = first.withColumns({"semantic_gate": F.when(seq() % 10 == 1, "neither").otherwise(F.col("semantic_gate")), "preference": F.when(seq() % 7 == 0, "tie").otherwise(F.col("preference"))})
    consensus = o.where("seq % 2 = 1").withColumns({"decision_status": L("complete"), "semantic_gate": L("a-only"), "preference": L("candidate-b"), "nonverbal": L(False),
                                                   "recorded_by": F.when(seq() % 6 == 1, F.array(L("x"), L("x"))).otherwise(F.array(L("x"), L("y"))), "agreed": L(True)})
    even = seq() % 2 == 0
    key = o.withColumns({"candidate_a_variant": F.when(even, "baseline").otherwise("improvement"), "candidate_b_variant": F.when(even, "improvement").otherwise("baseline")})
    return el.adjudicate(first, second, consensus, key, ("semantic_gate", "preference", "nonverbal"))


@query("agg20_unblinded_choices", with_(OR, BLIND) + """,
bad AS (SELECT DISTINCT stream_id FROM b WHERE seq % 300 = 0),
c AS (SELECT stream_id, CASE seq % 3 WHEN 0 THEN CASE WHEN ev THEN 'baseline' ELSE 'improvement' END WHEN 1 THEN CASE WHEN ev THEN 'improvement' ELSE 'baseline' END ELSE 'tie' END AS variant FROM bl ANTI JOIN bad USING (stream_id))
SELECT stream_id, variant, count(*) AS chosen FROM c GROUP BY ALL UNION ALL SELECT stream_id, 'withheld', NULL FROM bad""")
def agg20(spark, sf):
    key = pack(spark, sf)[1]
    choice = F.when(seq() % 3 == 0, "a").when(seq() % 3 == 1, "b").otherwise("tie")
    choices = key.where("seq % 300 <> 0").select("stream_id", "seq", choice.alias("choice"))
    return el.unblinded_choices(choices, key)


@query("agg21_judge_tallies", """WITH v AS (SELECT l_suppkey % 20 AS stream_id, l_partkey % 3 AS evaluator, CASE WHEN l_quantity > 20 THEN 'win' WHEN l_quantity > 4 THEN 'tie' ELSE 'loss' END AS vote, l_discount = 0.09 AND l_suppkey % 20 = 3 AS critical FROM lineitem)
SELECT stream_id, evaluator, count(*) AS n, count(*) FILTER (vote = 'win') AS wins, count(*) FILTER (vote = 'tie') AS ties, count(*) FILTER (vote = 'loss') AS losses, count(*) FILTER (vote = 'loss' AND critical) AS critical_losses,
  (count(*) - count(*) FILTER (vote = 'loss')) >= 0.9 * count(*) AND count(*) FILTER (vote = 'loss' AND critical) = 0 AS passed FROM v GROUP BY ALL""")
def agg21(spark, sf):
    q = F.col("l_quantity")
    votes = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("stream_id"), (F.col("l_partkey") % 3).alias("evaluator"), F.when(q > 20, "win").when(q > 4, "tie").otherwise("loss").alias("vote"),
                                                ((F.col("l_discount") == 0.09) & (F.col("l_suppkey") % 20 == 3)).alias("critical"))
    return el.judge_tallies(votes)


@query("agg22_condition_means", """WITH r AS (SELECT l_shipdate, l_suppkey % 7 AS condition, CASE WHEN l_suppkey % 7 = 2 AND l_partkey % 500 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS m1, CAST(round(l_discount * 100) AS BIGINT) AS m2 FROM lineitem)
SELECT condition, count(*) AS n, bool_and(m1 IS NOT NULL) AS valid, round(CASE WHEN bool_and(m1 IS NOT NULL) THEN avg(m1) END, 6) AS avg_m1, round(CASE WHEN bool_and(m1 IS NOT NULL) THEN avg(m2) END, 6) AS avg_m2 FROM r GROUP BY ALL""")
def agg22(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("condition"), F.when(~((F.col("l_suppkey") % 7 == 2) & (F.col("l_partkey") % 500 == 0)), F.col("l_quantity").cast("long")).alias("m1"), F.round(F.col("l_discount") * 100).cast("long").alias("m2"))
    return el.condition_means(rows, ["m1", "m2"]).withColumns({c: rounded(c, 6) for c in ("avg_m1", "avg_m2")})


@query("agg27_split_leakage", """WITH r AS (SELECT o_custkey AS stream_id, CASE WHEN o_custkey % 11 = 0 THEN 's' || CAST(o_orderkey % 3 AS VARCHAR) ELSE 's' || CAST(o_custkey % 3 AS VARCHAR) END AS split FROM orders)
SELECT stream_id, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM r GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def agg27(spark, sf):
    return el.split_leakage(split_rows(spark, sf)).withColumn("splits", F.array_join("splits", ","))


def split_rows(spark, sf):
    part = F.when(F.col("o_custkey") % 11 == 0, F.col("o_orderkey") % 3).otherwise(F.col("o_custkey") % 3)
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("stream_id"), F.concat(L("s"), part.cast("string")).alias("split"), (F.col("o_orderkey") % 4 != 0).alias("adjudicated"), (F.col("o_orderkey") % 6 == 0).alias("sealed"))


@query("agg27_label_set", """WITH r AS (SELECT o_orderkey AS k, 's' || CAST(CASE WHEN o_custkey % 11 = 0 THEN o_orderkey % 3 ELSE o_custkey % 3 END AS VARCHAR) AS split FROM orders)
SELECT split, count(*) AS n, count(*) FILTER (k % 4 <> 0) AS adjudicated, count(*) FILTER (k % 6 = 0) AS sealed FROM r GROUP BY ALL""")
def agg27b(spark, sf):
    return el.label_set(split_rows(spark, sf))


@query("agg28_error_ledger", with_(REVIEW) + """,
g AS (SELECT *, error_type = 'Added' AND ref <> 'zz' AS ok FROM er),
p AS (SELECT stream_id, seq, count(*) FILTER (ok) AS errors, count(*) FILTER (ok AND severity = 'critical') AS critical, count(*) FILTER (NOT ok) AS bad, min(CASE WHEN ok THEN list_position(['critical', 'major', 'minor', 'neutral'], severity) END) AS r FROM g GROUP BY ALL)
SELECT rv.stream_id, rv.seq, coalesce(errors, 0) AS errors, coalesce(critical, 0) AS critical, coalesce(bad, 0) AS invalid_records, coalesce(['critical', 'major', 'minor', 'neutral'][r], 'none') AS worst FROM rv LEFT JOIN p USING (stream_id, seq)""")
def agg28(spark, sf):
    r, e = reviewed(spark, sf)
    return el.error_ledger(r.select("stream_id", "seq"), e, ["Added"])


@query("agg28_repair_scenes", with_(REVIEW) + """
SELECT stream_id, seq // 10 AS scene, count(*) AS findings, count(*) FILTER (severity IN ('critical', 'major') AND error_type <> 'Added') AS blocking, count(*) FILTER (error_type = 'Added') AS dismissed, count(*) FILTER (severity IN ('critical', 'major') AND error_type <> 'Added') > 0 AS needs_repair FROM er GROUP BY ALL""")
def agg28b(spark, sf):
    _, e = reviewed(spark, sf)
    f = e.withColumns({"scene": F.floor(seq() / 10), "disposition": F.when(F.col("error_type") == "Added", "dismissed").otherwise("open")})
    return el.repair_scenes(f)


@query("agg29_audit_summary", with_(OR) + """,
h AS (SELECT *, sha256('a7|' || stream_id || '|' || seq) AS h FROM b WHERE text IN ('3-MEDIUM', '5-LOW')),
s AS (SELECT * FROM (SELECT *, min(h) OVER (PARTITION BY stream_id) AS f FROM h) WHERE h = f OR CAST(('0x' || substr(h, 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.2)
SELECT stream_id, count(*) AS sampled, count(*) FILTER (seq % 5 <> 0) AS reviewed, count(*) FILTER (seq % 5 = 0) AS unreviewed, count(*) FILTER (seq % 5 <> 0 AND seq % 3 = 0) AS error_findings, count(*) FILTER (seq % 5 <> 0 AND seq % 3 = 0 AND status = 'P') AS critical_findings,
  CASE WHEN count(*) FILTER (seq % 5 = 0) = 0 THEN 'descriptive-only' ELSE 'not-demonstrated' END AS metrics_status FROM s GROUP BY stream_id""")
def agg29(spark, sf):
    base, _ = order_rows(spark, sf)
    s = sm.bernoulli_audit(base.withColumn("band", F.col("text")), "a7", 0.2, ("3-MEDIUM", "5-LOW"))
    s = s.withColumns({"review_result": F.when(seq() % 5 != 0, "done").otherwise("unreviewed"), "mqm_error": F.when(seq() % 3 == 0, "x"), "severity": F.when(F.col("status") == "P", "critical").otherwise("minor")})
    return el.audit_summary(s)
