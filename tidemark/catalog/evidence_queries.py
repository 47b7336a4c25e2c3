"""Evidence operators on witnesses derived from events and annotator frames derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.frames import DAY, EV, TN, events, sql_compact, sql_jaccard, sql_key, sql_squeeze, table, turns, with_
from tidemark.catalog.registry import query
from tidemark.functions.numbers import rounded
from tidemark.operators import evidence as ev_
from tidemark.operators.ordered import Order, chunked

L = F.lit
ALIASES = (("alpha", "^(click|view)"), ("beta", "^purch"), ("gamma", "^err"))


def witnesses(spark, sf, days=DAY):
    """Every event is a witness of its user's day; its wording depends on the event's number k."""
    ev = events(spark, sf)
    day = F.floor(F.col("start_ms") / days)
    base = F.concat(L("day "), (day % 7).cast("string"), L(" word"))
    kind = F.col("k") % 5
    text = F.when(kind == 0, F.concat(base, L(" no"))).when(kind == 1, F.upper(base)).when(kind == 2, F.concat(base, L("?"))).when(kind == 3, base).otherwise(
        F.concat(L("zz "), F.col("k").cast("string"), L(" qq")))
    tier = F.when(F.col("k") % 4 <= 1, 3).when(F.col("k") % 4 == 2, 2).otherwise(1)
    return ev.select(
        "stream_id", day.alias("seq"), ev_.canonical_family(F.col("family"), ALIASES).alias("family"), F.col("family").alias("label"), text.alias("text"), tier.alias("tier"),
        "start_ms", "end_ms", F.col("seq").cast("string").alias("utterance_id"), F.col("cents").alias("overlap_ms"), F.col("k").alias("confidence"), "k",
    )


WIT = f"""wt AS (SELECT stream_id, start_ms // {DAY} AS seq, CASE WHEN family IN ('click', 'view') THEN 'alpha' WHEN family = 'purchase' THEN 'beta' WHEN family = 'error' THEN 'gamma' ELSE 'unverified' END AS family,
  family AS label, CASE k % 5 WHEN 0 THEN b || ' no' WHEN 1 THEN upper(b) WHEN 2 THEN b || '?' WHEN 3 THEN b ELSE 'zz ' || k || ' qq' END AS text,
  CASE WHEN k % 4 <= 1 THEN 3 WHEN k % 4 = 2 THEN 2 ELSE 1 END AS tier, start_ms, end_ms, CAST(seq AS VARCHAR) AS uid, cents, k
  FROM (SELECT *, 'day ' || CAST(start_ms // {DAY} % 7 AS VARCHAR) || ' word' AS b FROM ev))"""


@query("agg5_family_votes", with_(EV, WIT) + """
SELECT stream_id, seq, array_to_string(coalesce(list_sort(list(DISTINCT family) FILTER (family <> 'unverified')), []), ',') AS families, count(*) AS witnesses,
  count(DISTINCT CASE WHEN family <> 'unverified' THEN family END) AS independent_families, array_to_string(list_sort(list(DISTINCT family || '=' || label)), ',') AS lineage,
  CASE WHEN bool_or(family = 'unverified') THEN 'contains-unverified-family' ELSE 'known-family-aliases-normalized' END AS lineage_status FROM wt GROUP BY stream_id, seq""")
def agg5(spark, sf):
    w = witnesses(spark, sf).withColumn("family", F.col("label"))
    out = ev_.family_votes(w, ALIASES)
    return out.select("stream_id", "seq", F.array_join("families", ",").alias("families"), "witnesses", "independent_families",
                      F.array_join("lineage", ",").alias("lineage"), "lineage_status")


FLIPS = ev_.FlipRules(
    flags={"negative": "no$", "question": r"\?$", "loud": "^day3"}, differs=(("negative", "polarity"), ("question", "question")), opposites=(("negative", "loud", "neg-loud"),)
)
FUSE = f"""n0 AS (SELECT *, {sql_key('text')} AS norm, max(tier) OVER (PARTITION BY stream_id, seq, family) AS mt FROM wt),
t3 AS (SELECT stream_id, seq, family, mt, string_agg({sql_squeeze('text')}, ' ' ORDER BY start_ms, end_ms, uid) AS text FROM (
   SELECT *, row_number() OVER (PARTITION BY stream_id, seq, family, norm ORDER BY start_ms, end_ms, uid, text) AS rn FROM n0 WHERE tier = mt AND mt = 3 AND norm <> '') WHERE rn = 1 GROUP BY ALL),
t1 AS (SELECT stream_id, seq, family, mt, {sql_squeeze('text')} AS text FROM (
   SELECT *, row_number() OVER (PARTITION BY stream_id, seq, family ORDER BY cents DESC, k DESC, abs(end_ms - start_ms), norm DESC, text DESC, uid DESC) AS rn FROM n0 WHERE tier = mt AND mt < 3 AND norm <> '') WHERE rn = 1),
hy AS (SELECT *, {sql_key('text')} AS norm FROM (SELECT * FROM t3 UNION ALL SELECT * FROM t1)),
pp AS (SELECT a.stream_id, a.seq, a.norm AS ln, b.norm AS rn, {sql_compact('lower(a.text)')} AS lt, {sql_compact('lower(b.text)')} AS rt FROM hy a JOIN hy b ON a.stream_id = b.stream_id AND a.seq = b.seq AND a.family < b.family),
pr AS (SELECT *, {sql_jaccard('ln', 'rn')} AS sim, list_filter([CASE WHEN suffix(lt, 'no') <> suffix(rt, 'no') THEN 'polarity' END, CASE WHEN suffix(lt, '?') <> suffix(rt, '?') THEN 'question' END,
   CASE WHEN (suffix(lt, 'no') AND prefix(rt, 'day3')) OR (suffix(rt, 'no') AND prefix(lt, 'day3')) THEN 'neg-loud' END], lambda x: x IS NOT NULL) AS risks FROM pp),
jd AS (SELECT stream_id, seq, bool_and(ln = rn) AS ex, bool_and(len(risks) = 0 AND (ln = rn OR (least(length(ln), length(rn)) >= 2 AND (contains(ln, rn) OR contains(rn, ln) OR sim >= 0.55)))) AS ft,
   list_sort(list_distinct(flatten(list(risks)))) AS rk, min(sim) AS ms FROM pr GROUP BY stream_id, seq),
hg AS (SELECT stream_id, seq, count(*) AS n, min(mt) AS mn, string_agg(family, ',' ORDER BY family) AS families, string_agg(text, '|' ORDER BY family) AS texts FROM hy GROUP BY stream_id, seq),
fu AS (SELECT k.stream_id, k.seq, CASE WHEN n IS NULL THEN 'empty' WHEN n = 1 THEN 'single_family' WHEN len(rk) > 0 THEN 'dual_conflict' WHEN ex THEN 'dual_agreement' WHEN ft THEN 'dual_compatible' ELSE 'dual_conflict' END AS state,
  CASE WHEN mn IS NULL THEN 'none' WHEN mn >= 3 THEN 'block-aligned' WHEN mn >= 2 THEN 'expanded' ELSE 'context-only' END AS alignment_strength, coalesce(array_to_string(rk, ','), '') AS risk_codes,
  round(ms, 6) AS min_similarity, families, texts, n FROM (SELECT DISTINCT stream_id, seq FROM wt) k LEFT JOIN hg USING (stream_id, seq) LEFT JOIN jd USING (stream_id, seq))"""


@query("agg6_witness_fusion", with_(EV, WIT, FUSE) + "SELECT stream_id, seq, state, alignment_strength, risk_codes, min_similarity, families, texts FROM fu")
def agg6(spark, sf):
    out = ev_.fuse_witnesses(witnesses(spark, sf), FLIPS)
    return out.select(
        "stream_id", "seq", "state", "alignment_strength", F.array_join("risk_codes", ",").alias("risk_codes"), rounded("min_similarity", 6).alias("min_similarity"),
        F.array_join("families", ",").alias("families"), F.array_join("texts", "|").alias("texts"),
    )


@query("agg6_witness_fusion_sequence_ratio")
def agg6b(spark, sf):
    out = ev_.fuse_witnesses(witnesses(spark, sf), FLIPS, similar="sequence", spans=True)
    return out.select("stream_id", "seq", "state", F.array_join("shared_spans", ",").alias("shared_spans"), rounded("min_similarity", 6).alias("min_similarity"))


@query("agg7_confirmed_conflicts", """WITH e AS (SELECT o_custkey AS stream_id, o_orderpriority AS slot, CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' WHEN o_orderkey % 3 = 1 THEN 'approved' ELSE 'candidate' END AS status,
  CASE o_orderstatus WHEN 'P' THEN 'unknown' ELSE o_orderstatus END AS value FROM orders)
SELECT stream_id, slot, array_to_string(list_sort(list(DISTINCT value)), ',') AS values_found, count(*) AS entries FROM e WHERE status <> 'candidate' AND value <> 'unknown' GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def agg7(spark, sf):
    third = F.col("o_orderkey") % 3
    entries = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("stream_id"), F.col("o_orderpriority").alias("slot"),
        F.when(third == 0, "confirmed").when(third == 1, "approved").otherwise("candidate").alias("status"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderstatus")).alias("value"),
    )
    out = ev_.confirmed_conflicts(entries, ["stream_id", "slot"])
    return out.select("stream_id", "slot", F.array_join("values", ",").alias("values_found"), "entries")


PASSES = f"""ps AS (SELECT stream_id, start_ms // {DAY} AS scene, CASE family WHEN 'click' THEN 'base_a' WHEN 'view' THEN 'base_b' ELSE 'extra' END AS profile, arg_min(CASE WHEN k % 6 = 0 THEN '' ELSE 'take ' || CAST(k % 3 AS VARCHAR) || ' of day' END, seq) AS text,
  arg_min(-(k % 13) / 10.0, seq) AS lp, arg_min(k % 9 / 10.0, seq) AS ns, arg_min(CASE WHEN k % 10 = 0 THEN 'bad' ELSE '' END, seq) AS er FROM ev GROUP BY ALL),
pv AS (SELECT stream_id, scene, max(CASE WHEN profile = 'base_a' THEN trim(text) END) AS lt, max(CASE WHEN profile = 'base_b' THEN trim(text) END) AS rt, bool_or(profile = 'extra' AND trim(text) <> '') AS xt,
  coalesce(bool_or(profile <> 'extra' AND lp < -1.0), false) AS low, coalesce(bool_or(profile <> 'extra' AND ns > 0.6), false) AS hi, coalesce(bool_or(profile <> 'extra' AND er <> ''), false) AS er,
  coalesce(bool_and(CASE WHEN profile <> 'extra' THEN er <> '' END), true) AS ae FROM ps GROUP BY ALL),
sm AS (SELECT *, coalesce(lt, '') AS a, coalesce(rt, '') AS b, {sql_jaccard(sql_key("coalesce(lt, '')"), sql_key("coalesce(rt, '')"))} AS sim FROM pv)"""


@query("agg8_pass_pairs", with_(EV, PASSES) + """
SELECT stream_id, scene, round(sim, 6) AS similarity, array_to_string(list_sort(list_filter([CASE WHEN a = '' OR b = '' THEN 'empty' END, CASE WHEN sim < 0.82 THEN 'disagree' END, CASE WHEN low THEN 'low_logprob' END,
  CASE WHEN hi THEN 'high_no_speech' END, CASE WHEN er THEN 'error' END], lambda x: x IS NOT NULL)), ',') AS reasons,
  CASE WHEN a = '' AND b = '' AND ae THEN 'unresolved' WHEN a = '' AND b = '' THEN 'nonverbal' WHEN a <> '' AND b <> '' AND sim >= 0.92 THEN 'stable' WHEN a <> '' AND b <> '' AND sim >= 0.75 THEN 'normalized'
   WHEN xt THEN 'context-resolved' ELSE 'unresolved' END AS verdict FROM sm""")
def agg8(spark, sf):
    ev = events(spark, sf)
    profile = F.when(F.col("family") == "click", "base_a").when(F.col("family") == "view", "base_b").otherwise("extra")
    text = F.when(F.col("k") % 6 == 0, "").otherwise(F.concat(L("take "), (F.col("k") % 3).cast("string"), L(" of day")))
    rows = ev.groupBy("stream_id", F.floor(F.col("start_ms") / DAY).alias("scene"), profile.alias("profile")).agg(
        F.min_by(text, "seq").alias("text"), F.min_by(-(F.col("k") % 13) / 10.0, "seq").alias("avg_logprob"), F.min_by(F.col("k") % 9 / 10.0, "seq").alias("no_speech_prob"),
        F.min_by(F.when(F.col("k") % 10 == 0, "bad").otherwise(""), "seq").alias("error"),
    )
    out = ev_.pass_pairs(rows, ("base_a", "base_b"), ["extra"])
    return out.select("stream_id", "scene", rounded("similarity", 6).alias("similarity"), F.array_join("reasons", ",").alias("reasons"), "verdict")


@query("agg8_slot_conflicts", """WITH c AS (SELECT o_custkey AS stream_id, o_orderkey % 9 AS scene, s.slot, CASE o_orderkey % 4 WHEN 0 THEN 'unknown' ELSE 'confirmed' END AS state,
  CASE o_orderkey % 6 WHEN 0 THEN '' ELSE s.slot || CAST((o_orderkey // 7) % s.n AS VARCHAR) END AS value FROM orders, (VALUES ('polarity', 1), ('actor', 2), ('location', 3), ('mood', 3)) s(slot, n) WHERE o_orderkey % 11 NOT IN (0, 1)),
x AS (SELECT stream_id, scene, slot FROM c WHERE slot <> 'mood' AND state = 'confirmed' AND value <> '' GROUP BY ALL HAVING count(DISTINCT value) > 1)
SELECT stream_id, scene, array_to_string(list_sort(list(slot)), ',') AS conflicts FROM x GROUP BY ALL""")
def agg8b(spark, sf):
    """Claims as JSON text: some broken, some a bare word, some of slots that don't matter."""
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "unknown").otherwise("confirmed")

    def claim(slot, n):
        value = F.when(k % 6 == 0, "").otherwise(F.concat(L(slot), (F.floor(k / 7) % n).cast("string"), L(" ")))
        return F.struct(state.alias("state"), value.alias("value"), k.alias("note")).alias(slot)

    full = F.to_json(F.struct(claim("polarity", 1), claim("actor", 2), claim("location", 3), claim("mood", 3), L("bare").alias("target")))
    slots = F.when(k % 11 == 0, "{broken").when(k % 11 == 1, '["no object"]').otherwise(full)
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("stream_id"), (k % 9).alias("scene"), slots.alias("slots"))
    return ev_.slot_conflicts(rows).withColumn("conflicts", F.array_join("conflicts", ","))


# --- two annotators per order --------------------------------------------------------------

VOC = {
    "speech_act": ["statement", "question", "command", "refusal", "vocalization", "response", "permission"], "question": ["true", "false", "false"],
    "polarity": ["positive", "negative", "neutral"], "refusal_permission": ["refusal", "permission", "none", "none", "none"], "command_strength": ["suggestion", "command", "none", "none"],
    "speaker": ["a", "b"], "actor": ["a", "b", "unknown"], "action": ["go", "stay", "take"], "target": ["x", "y"], "location": ["here", "there"],
    "tense_aspect": ["past", "present", "progressive"], "direction": ["up", "down", "in"], "intensity": ["low", "high"],
}


def frames(spark, sf):
    """Two annotators' frames per order; left values first, so the right ones can copy them cheaply."""
    k = F.col("seq")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("seq"))
    lefts, rights, left_map, right_map = [], [], [], []

    def support(n, dual):
        source = F.struct(L("source-text").alias("basis"), F.array(L("src")).alias("refs"))
        return F.when(n == 0, source).when(n == 1, F.struct(L("dual-asr").alias("basis"), F.array(*[L(d) for d in dual]).alias("refs")))

    for j, s in enumerate(ev_.SLOTS):
        n = len(VOC[s])
        words = F.array(*[L(w) for w in VOC[s]])
        idx = (k * (j + 3) + j) % n
        lefts.append(F.when((k + j) % 5 != 0, F.get(words, idx.cast("int"))).alias(f"left_{s}"))
        pick = (k * 7 + j * 3) % 17
        rights.append(F.when(pick == 0, F.get(words, ((idx + 1) % n).cast("int"))).when(pick != 1, F.col(f"left_{s}")).alias(f"right_{s}"))
        left_map += [L(s), F.get("_l3", j % 3)]
        right_map += [L(s), F.get("_r4", (2 * j) % 4)]
    # supports repeat with period 3 and 4 over the slots
    orders = orders.withColumns(
        {"_l3": F.array(*[support((k + j) % 3, ("f1", "f2")) for j in range(3)]), "_r4": F.array(*[support((k + j) % 4, ("f1",)) for j in range(4)])}
    )
    rows = orders.select("stream_id", "seq", "_l3", "_r4", *lefts)
    return rows.select(
        "stream_id", "seq", *[f"left_{s}" for s in ev_.SLOTS], *rights, F.create_map(*left_map).alias("left_support"), F.create_map(*right_map).alias("right_support"),
        F.when(k % 3 == 0, "trusted").otherwise("suspect").alias("source_quality"), L("src").alias("source_ref"), F.when(k % 4 <= 1, "dual_agreement").otherwise("single_family").alias("fusion_state"),
        F.when(k % 5 <= 2, "block-aligned").otherwise("expanded").alias("alignment_strength"), F.array(F.array(L("f1")), F.array(L("f2"), L("f9"))).alias("fusion_refs"), (k % 11 == 0).alias("context_retried"),
    )


def frames_sql() -> str:
    S = ev_.SLOTS
    lines, norm, prov = [], [], []
    for j, s in enumerate(S):
        n = len(VOC[s])
        words = "[" + ", ".join(f"'{w}'" for w in VOC[s]) + "]"
        idx = f"((k * {j + 3} + {j}) % {n})"
        left = f"CASE WHEN (k + {j}) % 5 <> 0 THEN {words}[{idx} + 1] END"
        right = f"CASE WHEN (k * 7 + {j * 3}) % 17 = 0 THEN {words}[(({idx} + 1) % {n}) + 1] WHEN (k * 7 + {j * 3}) % 17 <> 1 THEN {left} END"
        lines.append(f"{left} AS x{j}, {right} AS y{j}")
        void = ["unknown"] + (["none"] if s in ("refusal_permission", "command_strength") else []) + (["neutral"] if s == "polarity" else [])
        bad = ", ".join(f"'{v}'" for v in void)
        norm.append(f"CASE WHEN x{j} NOT IN ({bad}) THEN x{j} END AS l{j}, CASE WHEN y{j} NOT IN ({bad}) THEN y{j} END AS r{j}")
        aligned = "k % 5 <= 2" if s in ev_.FLIPPING + ev_.STRUCTURAL else "true"
        lsup = f"((k + {j}) % 3 = 0 AND k % 3 = 0 OR (k + {j}) % 3 = 1 AND k % 4 <= 1 AND {aligned})"
        rsup = f"((k + {2 * j}) % 4 = 0 AND k % 3 = 0)"
        if s in ev_.FLIPPING or s == "action":
            block = "true"
        elif s == "direction":
            block = f"((l{j} = 'up' AND r{j} = 'down') OR (l{j} = 'down' AND r{j} = 'up'))"
        elif s == "tense_aspect":
            block = f"((l{j} = 'past' AND r{j} <> 'past') OR (r{j} = 'past' AND l{j} <> 'past'))"
        elif s == "intensity":
            block = "(NOT coalesce(l4 = r4, false) AND (coalesce(l0 IN ('command', 'prohibition', 'refusal'), false) OR coalesce(r0 IN ('command', 'prohibition', 'refusal'), false) OR l3 IS NOT NULL OR r3 IS NOT NULL))"
        else:
            block = "false"
        prov.append(
            f"CASE WHEN l{j} IS NULL AND r{j} IS NULL THEN 'absent' WHEN l{j} IS NOT DISTINCT FROM r{j} THEN 'dual_agreement' WHEN l{j} IS NOT NULL AND {lsup} AND NOT {rsup} THEN 'left_only_supported' "
            f"WHEN r{j} IS NOT NULL AND {rsup} AND NOT {lsup} THEN 'right_only_supported' WHEN l{j} IS NULL OR r{j} IS NULL THEN 'absent' WHEN {block} THEN 'conflict_blocking' ELSE 'conflict_omitted' END AS p{j}"
        )
    chosen = ", ".join(f"CASE WHEN p{j} IN ('dual_agreement', 'left_only_supported') THEN l{j} WHEN p{j} = 'right_only_supported' THEN r{j} END AS s{j}" for j in range(13))
    detail = [S.index(s) for s in ev_.DETAIL_SLOTS]
    any_detail = " OR ".join(f"s{j} IS NOT NULL" for j in detail)
    final = ", ".join(
        f"CASE WHEN NOT f4 THEN s{j} END AS z{j}" if j in detail else (f"CASE WHEN NOT f3 THEN s{j} END AS z{j}" if j == 4 else f"s{j} AS z{j}") for j in range(13)
    )

    def listed(cond: str) -> str:
        items = ", ".join(f"CASE WHEN {cond.replace('#', str(j))} THEN '{s}' END" for j, s in enumerate(S))
        return f"list_sort(list_filter([{items}], lambda x: x IS NOT NULL))"

    core = ", ".join(f"z{S.index(s)}" for s in ev_.CORE_SLOTS)
    return f"""f0 AS (SELECT o_custkey AS stream_id, o_orderkey AS k, {', '.join(lines).replace('k *', 'o_orderkey *').replace('(k +', '(o_orderkey +')} FROM orders),
f1 AS (SELECT *, {', '.join(norm)} FROM f0),
f2 AS (SELECT *, {', '.join(prov)} FROM f1),
f3_ AS (SELECT *, {chosen} FROM f2),
f4_ AS (SELECT *, coalesce((s1 = 'true' AND s0 NOT IN ('question', 'request')) OR (s0 = 'question' AND s1 = 'false'), false) AS f1,
  coalesce(s0 IS NOT NULL AND ((s3 = 'refusal' AND s0 NOT IN ('refusal', 'response')) OR (s3 = 'permission' AND s0 NOT IN ('permission', 'response'))), false) AS f2,
  coalesce(s4 IS NOT NULL AND s0 IS NOT NULL AND s0 NOT IN ('request', 'command', 'prohibition'), false) AS f3, coalesce(s0 IN ('vocalization', 'nonverbal'), false) AND ({any_detail}) AS f4 FROM f3_),
f5 AS (SELECT *, {final} FROM f4_),
f6 AS (SELECT *, coalesce({core}) IS NULL AS f5e, {listed('l# IS NOT NULL AND r# IS NOT NULL AND l# <> r#')} AS conflicts, {listed('(l# IS NULL) <> (r# IS NULL)')} AS gaps, {listed("p# = 'conflict_blocking'")} AS blocking,
  {listed("l# IS NOT NULL AND r# IS NOT NULL AND p# IN ('left_only_supported', 'right_only_supported')")} AS resolved, {listed('z# IS NOT NULL')} AS rendered, {' OR '.join(f"p{j} IN ('left_only_supported', 'right_only_supported')" for j in range(13))} AS single FROM f5),
f7 AS (SELECT *, coalesce(z0 IN ('refusal', 'prohibition', 'response', 'vocalization', 'nonverbal') OR (z0 IN ('statement', 'question', 'request', 'command', 'permission') AND z7 IS NOT NULL), false) AS mini,
  len(list_filter(blocking, lambda x: x IN ('speech_act', 'question', 'polarity', 'refusal_permission', 'command_strength'))) > 0 AS flip, f1 OR f2 OR f5e AS high FROM f6),
ar AS (SELECT *, CASE WHEN coalesce(z0 IN ('vocalization', 'nonverbal'), false) AND len(blocking) = 0 THEN 'vocalization' WHEN len(blocking) > 0 AND NOT high AND NOT flip AND mini THEN 'minimal_speech_act'
   WHEN len(blocking) > 0 OR high THEN 'abstained' WHEN single THEN 'recovered_single_model' WHEN k % 11 = 0 THEN 'recovered_context' WHEN len(conflicts) = 0 AND len(gaps) = 0 THEN 'accepted_consensus'
   WHEN mini THEN 'accepted_partial' ELSE 'abstained' END AS state,
   list_filter([CASE WHEN f1 THEN 'question-speech-act-mismatch' END, CASE WHEN f2 THEN 'refusal-permission-speech-act-mismatch' END, CASE WHEN f3 THEN 'command-strength-speech-act-mismatch' END,
     CASE WHEN f4 THEN 'nonlexical-frame-retains-semantic-detail' END, CASE WHEN f5e THEN 'empty-semantic-core' END], lambda x: x IS NOT NULL) AS findings FROM f7)"""


@query("agg9_slot_arbitration", with_(frames_sql()) + """
SELECT stream_id, k AS seq, state, array_to_string(conflicts, ',') AS conflicts, array_to_string(gaps, ',') AS coverage_gaps, array_to_string(blocking, ',') AS blocking, array_to_string(resolved, ',') AS resolved,
  array_to_string(rendered, ',') AS rendered, array_to_string(findings, ',') AS findings FROM ar""")
def agg9(spark, sf):
    out = ev_.arbitrate_slots(frames(spark, sf))
    joined = [F.array_join(c, ",").alias(c) for c in ("conflicts", "coverage_gaps", "blocking", "resolved", "rendered", "findings")]
    return out.select("stream_id", "seq", "state", *joined)


ROUTE = """rt AS (SELECT user_id AS stream_id, event_id AS seq, k, ['lexical', 'vocalization', 'nonverbal', 'corrupt', 'empty'][k % 5 + 1] AS source_kind, k % 3 <> 0 AS trusted, k % 29 = 0 AS short,
  ['vocalization', 'nonverbal', 'unknown', 'lexical', 'unknown', 'vocalization', 'nonverbal'][k % 7 + 1] AS frame_kind, ['vocalization', 'unknown', 'nonverbal', 'unknown', 'vocalization', 'nonverbal', 'unknown', 'lexical'][k % 8 + 1] AS fusion_kind
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)),
r2 AS (SELECT *, CASE WHEN trusted AND source_kind NOT IN ('corrupt', 'empty') THEN source_kind ELSE 'unknown' END AS u, (trusted AND short) OR frame_kind = 'lexical' OR fusion_kind = 'lexical' AS lex FROM rt),
r3 AS (SELECT *, CASE WHEN lex THEN 'lexical_speech' WHEN CAST(u = 'vocalization' AS INT) + CAST(frame_kind = 'vocalization' AS INT) + CAST(fusion_kind = 'vocalization' AS INT) >= 2 THEN 'vocalization'
   WHEN CAST(u = 'nonverbal' AS INT) + CAST(frame_kind = 'nonverbal' AS INT) + CAST(fusion_kind = 'nonverbal' AS INT) >= 2 THEN 'nonverbal' ELSE 'unknown' END AS kind FROM r2)"""


@query("agg10_utterance_routing", with_(ROUTE) + """
SELECT stream_id, seq, kind AS utterance_kind, CASE WHEN lex THEN CASE WHEN trusted AND source_kind = 'lexical' AND frame_kind = 'lexical' THEN 'high' ELSE 'medium' END
  WHEN kind <> 'unknown' THEN CASE WHEN fusion_kind = kind THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence FROM r3""")
def agg10(spark, sf):
    k = F.col("k")

    def pick(words, n):
        return F.get(F.array(*[L(w) for w in words]), (k % n).cast("int"))

    rows = events(spark, sf).select(
        "stream_id", "seq", pick(["lexical", "vocalization", "nonverbal", "corrupt", "empty"], 5).alias("source_kind"), (k % 3 != 0).alias("source_trusted"), (k % 29 == 0).alias("meaningful_short"),
        pick(["vocalization", "nonverbal", "unknown", "lexical", "unknown", "vocalization", "nonverbal"], 7).alias("frame_kind"),
        pick(["vocalization", "unknown", "nonverbal", "unknown", "vocalization", "nonverbal", "unknown", "lexical"], 8).alias("fusion_kind"),
    )
    return ev_.route_utterance(rows).select("stream_id", "seq", "utterance_kind", "confidence")


@query("agg11_evidence_ceiling", with_(EV, WIT, FUSE) + """
SELECT stream_id, count(*) AS segments, count(*) FILTER (ok) AS eligible, round(CAST(count(*) FILTER (ok) AS DOUBLE) / count(*), 6) AS max_rate, count(*) FILTER (ok) >= 0.4 * count(*) AS allowed
FROM (SELECT *, seq % 3 = 0 OR coalesce(n >= 2 AND state IN ('dual_agreement', 'dual_compatible') AND (alignment_strength = 'block-aligned' OR (alignment_strength = 'expanded' AND seq % 2 = 0)) AND risk_codes = '', false) AS ok FROM fu) GROUP BY stream_id""")
def agg11(spark, sf):
    fused = ev_.fuse_witnesses(witnesses(spark, sf), FLIPS).withColumns(
        {
            "source_quality": F.when(F.col("seq") % 3 == 0, "trusted").otherwise("suspect"),
            "block_alignment_status": F.when(F.col("seq") % 2 == 0, "single-block-expanded").otherwise("none"),
        }
    )
    return ev_.evidence_ceiling(fused, 0.4).withColumn("max_rate", rounded("max_rate", 6))


CAND = f"""cd AS (SELECT stream_id, start_ms // {DAY} AS seq, CASE family WHEN 'click' THEN 'f1' WHEN 'view' THEN 'f2' WHEN 'error' THEN 'previous' ELSE 'f3' END AS family, CASE k % 3 WHEN 0 THEN 'source-faithful' WHEN 1 THEN 'viewer-natural' ELSE 'previous' END AS role,
   lpad(CAST(seq AS VARCHAR), 12, '0') AS path, CASE WHEN k % 4 = 0 THEN 'other words ' || k ELSE 'the same text ' || CAST(k % 2 AS VARCHAR) END AS text, k % 9 = 0 AS bad FROM ev),
ok AS (SELECT *, {sql_key('text')} AS norm FROM cd WHERE NOT bad),
rp AS (SELECT stream_id, seq, family, arg_min(norm, {{'a': role <> 'source-faithful', 'b': role = 'previous', 'p': path}}) AS norm, coalesce(arg_min(text, path) FILTER (role = 'source-faithful'), arg_min(text, path)) AS s,
  coalesce(arg_min(text, path) FILTER (role = 'viewer-natural'), arg_min(text, path) FILTER (role = 'source-faithful'), arg_min(text, path)) AS v FROM ok GROUP BY ALL),
ms AS (SELECT a.stream_id, a.seq, min({sql_jaccard('a.norm', 'b.norm')}) AS m FROM rp a JOIN rp b ON a.stream_id = b.stream_id AND a.seq = b.seq AND a.family < b.family GROUP BY ALL),
pg AS (SELECT stream_id, seq, count(*) AS nf, count(*) FILTER (family <> 'previous') AS ng, arg_min(family, family) FILTER (family <> 'previous') AS pf, arg_min(s, family) FILTER (family <> 'previous') AS ps, arg_min(v, family) FILTER (family <> 'previous') AS pv FROM rp GROUP BY ALL),
sg AS (SELECT DISTINCT stream_id, seq FROM cd),
rs AS (SELECT sg.*, nf, pf, ps, pv, list_sort(list_filter([CASE WHEN sg.seq % 10 = 0 THEN 'missing-source' END, CASE WHEN coalesce(ng, 0) = 0 THEN 'no-generated-candidate' END, CASE WHEN coalesce(ng, 0) < 2 THEN 'insufficient-generated-families' END,
   CASE WHEN m < 0.72 THEN 'candidate-family-disagreement' END], lambda x: x IS NOT NULL)) AS reasons FROM sg LEFT JOIN pg USING (stream_id, seq) LEFT JOIN ms USING (stream_id, seq))"""


def candidates(spark, sf):
    ev = events(spark, sf)
    family = F.when(F.col("family") == "click", "f1").when(F.col("family") == "view", "f2").when(F.col("family") == "error", "previous").otherwise("f3")
    role = F.when(F.col("k") % 3 == 0, "source-faithful").when(F.col("k") % 3 == 1, "viewer-natural").otherwise("previous")
    text = F.when(F.col("k") % 4 == 0, F.concat(L("other words "), F.col("k").cast("string"))).otherwise(F.concat(L("the same text "), (F.col("k") % 2).cast("string")))
    none = F.array().cast("array<string>")
    return ev.select("stream_id", F.floor(F.col("start_ms") / DAY).alias("seq"), family.alias("family"), role.alias("role"), F.lpad(F.col("seq").cast("string"), 12, "0").alias("path"), text.alias("text"),
                     F.when(F.col("k") % 9 == 0, F.array(L("bad"))).otherwise(none).alias("errors"))


def decisions(spark, sf):
    cand = candidates(spark, sf)
    none = F.array().cast("array<string>")
    seg = cand.select("stream_id", "seq").distinct().withColumn("reasons", F.when(F.col("seq") % 10 == 0, F.array(L("missing-source"))).otherwise(none))
    return ev_.decide_candidates(cand, seg)


@query("agg12_candidate_decision", with_(EV, CAND) + """
SELECT stream_id, seq, CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'abstained' END AS status, CASE WHEN len(reasons) = 0 THEN pf END AS selected_family, CASE WHEN len(reasons) = 0 THEN ps ELSE '' END AS source_text,
  CASE WHEN len(reasons) = 0 THEN pv ELSE '' END AS viewer_text, coalesce(nf, 0) AS families, array_to_string(reasons, ',') AS reasons FROM rs""")
def agg12(spark, sf):
    return decisions(spark, sf).select("stream_id", "seq", "status", "selected_family", "source_text", "viewer_text", "families", F.array_join("reasons", ",").alias("reasons"))


@query("agg34_claim_check", with_(EV, CAND) + """,
rf AS (SELECT stream_id, seq, min(text) AS ref FROM cd WHERE family = 'f3' GROUP BY ALL)
SELECT rs.stream_id, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) = 0 AND ref IS NOT NULL) AS compared, count(*) FILTER (len(reasons) = 0 AND ref = ps) AS exact_matches,
  round(CASE WHEN count(*) FILTER (len(reasons) = 0 AND ref IS NOT NULL) > 0 THEN CAST(count(*) FILTER (len(reasons) = 0 AND ref = ps) AS DOUBLE) / count(*) FILTER (len(reasons) = 0 AND ref IS NOT NULL) END, 6) AS exact_rate,
  CASE WHEN count(*) FILTER (len(reasons) = 0 AND ref IS NOT NULL) = 0 THEN 'unidentifiable' WHEN count(*) FILTER (len(reasons) = 0 AND ref = ps) = count(*) FILTER (len(reasons) = 0) THEN 'equal' ELSE 'not_equal' END AS claim
FROM rs LEFT JOIN rf USING (stream_id, seq) GROUP BY rs.stream_id""")
def agg34(spark, sf):
    from tidemark.operators.evaluation import claim_check

    ref = candidates(spark, sf).where("family = 'f3'").groupBy("stream_id", "seq").agg(F.min("text").alias("ref_text"))
    out = claim_check(decisions(spark, sf), ref)
    return out.withColumn("exact_rate", rounded("exact_rate", 6))


GATE = """g0 AS (SELECT *, CASE k % 4 WHEN 0 THEN rendered WHEN 1 THEN list_concat(rendered, ['zzz']) WHEN 2 THEN [] ELSE rendered[1:1] END AS cl, CASE k % 3 WHEN 0 THEN ['action'] WHEN 1 THEN [] ELSE ['speech_act', 'intensity'] END AS fc,
   't' || k AS tx, CASE WHEN k % 7 = 0 THEN '…' ELSE 'f' || k END AS ft, k % 3 <> 0 AND k % 4 > 1 AND state <> 'vocalization' AS dmg FROM ar),
g1 AS (SELECT *, CASE WHEN dmg THEN CASE WHEN mini THEN 'minimal_speech_act' ELSE 'abstained' END ELSE state END AS st,
   CASE k % 3 WHEN 0 THEN p7 IN ('dual_agreement', 'dual_compatible') WHEN 1 THEN true ELSE p0 IN ('dual_agreement', 'dual_compatible') AND p12 IN ('dual_agreement', 'dual_compatible') END AS prv FROM g0),
g2 AS (SELECT *, CASE WHEN len(fc) = 0 OR NOT prv THEN 'abstained' WHEN st = 'minimal_speech_act' THEN st WHEN st = 'accepted_consensus' THEN CASE WHEN len(conflicts) = 0 AND len(gaps) = 0 THEN st ELSE 'accepted_partial' END
   WHEN st IN ('accepted_partial', 'recovered_context') THEN 'accepted_partial' ELSE 'abstained' END AS tier, (len(cl) = 0 OR len(list_filter(cl, lambda x: NOT list_contains(rendered, x))) > 0) AND st <> 'abstained' AS pov FROM g1),
g3 AS (SELECT *, len(fc) > 0 AND len(list_filter(fc, lambda x: NOT list_contains(rendered, x))) = 0 AND tier <> 'abstained' AND ft <> '…' AS fok, st = 'minimal_speech_act' OR pov AS wf FROM g2),
g4 AS (SELECT *, CASE WHEN st = 'abstained' THEN 'abstained' WHEN wf AND fok THEN CASE WHEN pov THEN tier ELSE st END WHEN wf THEN 'abstained' ELSE st END AS fs FROM g3),
g5 AS (SELECT *, CASE WHEN fs = 'abstained' THEN 'none' WHEN wf THEN 'fallback' ELSE 'primary' END AS used FROM g4),
g6 AS (SELECT *, CASE used WHEN 'primary' THEN tx WHEN 'fallback' THEN ft ELSE '…' END AS final_text FROM g5)"""


def gated(spark, sf):
    k = F.col("seq")
    none = F.array().cast("array<string>")
    rows = ev_.arbitrate_slots(frames(spark, sf)).withColumns(
        {
            "claims": F.when(k % 4 == 0, F.col("rendered")).when(k % 4 == 1, F.concat("rendered", F.array(L("zzz")))).when(k % 4 == 2, none).otherwise(F.slice("rendered", 1, 1)),
            "fallback_claims": F.when(k % 3 == 0, F.array(L("action"))).when(k % 3 == 1, none).otherwise(F.array(L("speech_act"), L("intensity"))),
            "text": F.concat(L("t"), k.cast("string")), "fallback_text": F.when(k % 7 == 0, "…").otherwise(F.concat(L("f"), k.cast("string"))),
            "source_quality": F.when(k % 3 == 0, "trusted").otherwise("suspect"), "dual_ok": k % 4 <= 1,
            "fully_agreed": (F.size("conflicts") == 0) & (F.size("coverage_gaps") == 0),
        }
    )
    return ev_.claim_gate(rows)


@query("agg35_claim_gate", with_(frames_sql(), GATE) + """SELECT stream_id, k AS seq, used, fs AS final_state, final_text, array_to_string(CASE used WHEN 'primary' THEN list_sort(cl) WHEN 'fallback' THEN list_sort(fc) ELSE [] END, ',') AS final_slots,
  array_to_string(list_filter([CASE WHEN dmg THEN 'damaged-source-without-two-family-evidence' END, CASE WHEN len(cl) = 0 THEN 'missing-claimed-slots' END, CASE WHEN len(list_filter(cl, lambda x: NOT list_contains(rendered, x))) > 0 THEN 'claims-omitted-slot' END], lambda x: x IS NOT NULL), ',') AS reason_codes FROM g6""")
def agg35(spark, sf):
    return gated(spark, sf).select("stream_id", "seq", "used", "final_state", "final_text", F.array_join("final_slots", ",").alias("final_slots"), F.array_join("reason_codes", ",").alias("reason_codes"))


@query("agg36_review_outcomes", with_(frames_sql(), GATE) + """,
h AS (SELECT *, CASE WHEN k % 13 <> 0 AND k % 5 <> 0 AND k % 6 <> 0 AND k % 9 <> 0 THEN 'kept' WHEN fok AND (k % 13 = 0 OR k % 10 <> 0) THEN 'fallback' ELSE 'abstained' END AS outcome FROM g6)
SELECT stream_id, k AS seq, outcome, CASE outcome WHEN 'kept' THEN final_text WHEN 'fallback' THEN ft ELSE '…' END AS reviewed_text FROM h""")
def agg36(spark, sf):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    reviews = table(spark, sf, "orders").where(k % 13 != 0).select(
        F.col("o_custkey").alias("stream_id"), k.alias("seq"), F.when(k % 5 != 0, "accept").otherwise("quarantine").alias("verdict"),
        F.when(k % 6 == 0, F.array(F.struct(L("blocking").alias("disposition")))).otherwise(F.array().cast("array<struct<disposition:string>>")).alias("findings"),
        F.when(k % 9 == 0, F.array(L("x"))).otherwise(none).alias("unsupported_additions"), (k % 10 == 0).alias("fallback_blocking"),
    )
    return ev_.apply_reviews(gated(spark, sf), reviews).select("stream_id", "seq", "outcome", "reviewed_text")


LEDGER = """lg AS (SELECT c_nationkey AS stream_id, c_custkey AS entry_id, CASE c_custkey % 2 WHEN 0 THEN 'term' ELSE 'tone' END AS entry_type, ['title', 'scene', 'speaker', 'relationship', 'temporary'][c_custkey % 5 + 1] AS scope, 'k' || CAST(c_custkey % 7 AS VARCHAR) AS key,
   c_mktsegment AS value, ['confirmed', 'confirmed', 'candidate', 'retired'][c_custkey % 4 + 1] AS status, ['s' || CAST(c_custkey % 6 AS VARCHAR), 's9'] AS scene_ids, 'p' || CAST(c_custkey % 3 AS VARCHAR) AS speaker_id, 'p' || CAST(c_custkey // 3 % 3 AS VARCHAR) AS addressee_id,
   CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 50 END AS sb, CASE WHEN c_custkey % 13 = 0 THEN 60 + c_custkey % 30 END AS eb FROM customer),
sgm AS (SELECT s_nationkey AS stream_id, s_suppkey AS seq, ['s' || CAST(s_suppkey % 6 AS VARCHAR), 's' || CAST(s_suppkey % 4 AS VARCHAR)] AS scenes, 'p' || CAST(s_suppkey % 3 AS VARCHAR) AS sp, 'p' || CAST(s_suppkey % 2 AS VARCHAR) AS ad, s_suppkey % 4 <> 0 AS trusted FROM supplier),
hit AS (SELECT g.stream_id, g.seq, l.* EXCLUDE (stream_id) FROM sgm g JOIN lg l ON g.stream_id = l.stream_id WHERE (sb IS NULL OR g.seq >= sb) AND (eb IS NULL OR g.seq <= eb)
  AND (scope IN ('title', 'temporary') OR (scope = 'scene' AND len(list_intersect(scene_ids, scenes)) > 0) OR (scope = 'speaker' AND trusted AND sp = speaker_id) OR (scope = 'relationship' AND trusted AND sp = speaker_id AND ad = addressee_id))),
cf AS (SELECT stream_id, seq, entry_type, scope, key, speaker_id, addressee_id FROM hit WHERE status = 'confirmed' GROUP BY ALL HAVING count(DISTINCT value) > 1)"""


@query("join12_scoped_ledger", with_(LEDGER) + """
SELECT h.stream_id, h.seq, entry_id, h.entry_type, h.scope, h.key, value, CASE WHEN status = 'confirmed' THEN CASE WHEN c.key IS NULL THEN 'applied' ELSE 'withheld_conflict' END ELSE 'unresolved' END AS use
FROM hit h LEFT JOIN cf c ON h.stream_id = c.stream_id AND h.seq = c.seq AND h.entry_type = c.entry_type AND h.scope = c.scope AND h.key = c.key AND h.speaker_id = c.speaker_id AND h.addressee_id = c.addressee_id WHERE status <> 'retired'""")
def join12(spark, sf):
    return ev_.apply_ledger(*ledger_frames(spark, sf))


def ledger_frames(spark, sf):
    c, s = F.col("c_custkey"), F.col("s_suppkey")

    def nth(words, i):
        return F.get(F.array(*[L(w) for w in words]), i.cast("int"))

    def tag(letter, n):
        return F.concat(L(letter), n.cast("string"))

    ledger = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("stream_id"), c.alias("entry_id"), F.when(c % 2 == 0, "term").otherwise("tone").alias("entry_type"),
        nth(["title", "scene", "speaker", "relationship", "temporary"], c % 5).alias("scope"), tag("k", c % 7).alias("key"), F.col("c_mktsegment").alias("value"),
        nth(["confirmed", "confirmed", "candidate", "retired"], c % 4).alias("status"), F.array(tag("s", c % 6), L("s9")).alias("scene_ids"), tag("p", c % 3).alias("speaker_id"),
        tag("p", F.floor(c / 3) % 3).alias("addressee_id"), F.when(c % 11 == 0, c % 50).alias("start_block"), F.when(c % 13 == 0, 60 + c % 30).alias("end_block"),
    )
    sup = table(spark, sf, "supplier")
    segments = sup.select(F.col("s_nationkey").alias("stream_id"), s.alias("seq"), F.array(tag("s", s % 6), tag("s", s % 4)).alias("scene_ids"))
    speakers = sup.select(F.col("s_nationkey").alias("stream_id"), s.alias("seq"), tag("p", s % 3).alias("speaker_id"), tag("p", s % 2).alias("addressee_id"), (s % 4 != 0).alias("trusted"))
    return ledger, segments, speakers


@query("join13_evidence_bundle", with_(TN, """sc AS (SELECT stream_id, seq // 3 AS scene, (stream_id + seq // 3) % 3 <> 0 AS aligned FROM tn WHERE (stream_id + seq // 3) % 7 <> 0 GROUP BY ALL),
wi AS (SELECT user_id % 100 AS stream_id, event_id % 3 AS scene, CAST(event_id AS VARCHAR) AS ref FROM events),
ww AS (SELECT stream_id, scene, count(*) AS n, string_agg(ref, ',' ORDER BY ref) AS refs FROM wi GROUP BY ALL),
nb AS (SELECT *, list(seq) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS bf, list(seq) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS af FROM tn)""") + """
SELECT t.stream_id, t.seq, coalesce(array_to_string(bf, ','), '') AS before, coalesce(array_to_string(af, ','), '') AS after, CASE WHEN coalesce(aligned, false) THEN coalesce(refs, '') ELSE '' END AS witness_refs,
  CASE WHEN t.seq % 2 = 0 THEN 'p ' || t.text END AS previous_text,
  array_to_string(list_sort(list_filter([CASE WHEN aligned IS NOT NULL AND NOT aligned THEN 'low-timeline-confidence' END, CASE WHEN aligned IS NOT NULL AND NOT aligned AND n > 0 THEN 'audio-evidence-withheld' END,
    CASE WHEN aligned IS NOT NULL AND n IS NULL THEN 'missing-witness' END, CASE WHEN aligned IS NOT NULL AND (t.stream_id + t.seq // 3) % 5 = 0 THEN 'scene-risk' END], lambda x: x IS NOT NULL)), ',') AS risk_codes
FROM nb t LEFT JOIN sc ON sc.stream_id = t.stream_id AND sc.scene = t.seq // 3 LEFT JOIN ww ON ww.stream_id = t.stream_id AND ww.scene = t.seq // 3""")
def join13(spark, sf):
    tn = turns(spark, sf).withColumn("scene", F.floor(F.col("seq") / 3))
    tn, order = chunked(tn, Order(by=("seq",)), 1000)
    mix = F.col("stream_id") + F.col("scene")
    none = F.array().cast("array<string>")
    scenes = tn.select("stream_id", "scene").distinct().where(mix % 7 != 0).withColumns(
        {"aligned": mix % 3 != 0, "risks": F.when(mix % 5 == 0, F.array(L("scene-risk"))).otherwise(none)})
    wit = table(spark, sf, "events").select((F.col("user_id") % 100).alias("stream_id"), (F.col("event_id") % 3).alias("scene"), F.col("event_id").cast("string").alias("ref"), L("w").alias("text"))
    previous = tn.where("seq % 2 = 0").select("stream_id", "seq", F.concat(L("p "), F.col("text")).alias("text"))
    out = ev_.evidence_bundle(tn, scenes, wit, previous, order)
    return out.select(
        "stream_id", "seq", F.array_join(F.col("before.seq").cast("array<string>"), ",").alias("before"), F.array_join(F.col("after.seq").cast("array<string>"), ",").alias("after"),
        F.array_join("witnesses.ref", ",").alias("witness_refs"), "previous_text", F.array_join("risk_codes", ",").alias("risk_codes"),
    )
