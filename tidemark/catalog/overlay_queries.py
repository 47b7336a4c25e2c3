"""Overlay, coverage, integrity and lineage queries on orders (one stream per customer)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.frames import EV, events, lines, LN, table, with_
from tidemark.catalog.registry import query
from tidemark.operators import overlay as ov
from tidemark.operators.ordered import Order, chunked

L = F.lit
WIDTH = 50_000
BY_SEQ = Order(by=("seq",))
# renumbered rows may share a number, so comparisons order by time as well
BY_ROW = Order(by=("seq", "start_ms", "end_ms"), chunk="_chunk")


def seq():
    return F.col("seq")


def rows(spark, sf):
    day = F.datediff("o_orderdate", L("1992-01-01")).cast("long")
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("stream_id"), k.alias("seq"), day.alias("start_ms"), (day + k % 5).alias("end_ms"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("status"),
    )
    return chunked(df, BY_SEQ, WIDTH)


OR = """b AS (SELECT o_custkey AS stream_id, o_orderkey AS seq, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start_ms,
  CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 5 AS BIGINT) AS end_ms, o_orderpriority AS text, o_orderstatus AS status FROM orders)"""
OTHER = "o AS (SELECT stream_id, seq + CASE WHEN seq % 53 = 0 THEN 1 ELSE 0 END AS seq, start_ms + CASE WHEN seq % 31 = 0 THEN 2 ELSE 0 END AS start_ms, end_ms, text, status FROM b WHERE seq % 97 <> 0)"
DIFF = """lp AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq, start_ms, end_ms) AS pos FROM b), rp AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq, start_ms, end_ms) AS pos FROM o),
fj AS (SELECT coalesce(l.stream_id, r.stream_id) AS stream_id, coalesce(l.pos, r.pos) AS pos, l.seq AS ls, r.seq AS rs, l.start_ms AS l0, r.start_ms AS r0, l.end_ms AS l1, r.end_ms AS r1, l.text AS lt, r.text AS rt
  FROM lp l FULL JOIN rp r ON l.stream_id = r.stream_id AND l.pos = r.pos),
df AS (SELECT stream_id, pos, unnest(list_filter([CASE WHEN rs IS NULL THEN 'missing_right' END, CASE WHEN ls IS NULL THEN 'missing_left' END, CASE WHEN ls <> rs THEN 'number_changed' END,
   CASE WHEN l0 <> r0 OR l1 <> r1 THEN 'time_changed' END], lambda x: x IS NOT NULL)) AS code FROM fj)"""


def other(base):
    return base.where("seq % 97 <> 0").withColumns(
        {"seq": seq() + F.when(seq() % 53 == 0, 1).otherwise(0), "start_ms": F.col("start_ms") + F.when(seq() % 31 == 0, 2).otherwise(0)}
    ).withColumn("_chunk", F.floor(F.col("seq") / WIDTH).cast("long"))


@query("join14_structure_diff", with_(OR, OTHER, DIFF) + "SELECT * FROM df")
def join14(spark, sf):
    base, _ = rows(spark, sf)
    return ov.structure_diff(base, other(base), BY_ROW)


@query("join14_same_structure", with_(OR, OTHER, DIFF) + """
SELECT stream_id, coalesce(n, 0) AS differences, coalesce(n, 0) = 0 AS same FROM (SELECT DISTINCT stream_id FROM b UNION SELECT DISTINCT stream_id FROM o) LEFT JOIN (SELECT stream_id, count(*) AS n FROM df GROUP BY ALL) USING (stream_id)""")
def join14b(spark, sf):
    base, _ = rows(spark, sf)
    return ov.same_structure(base, other(base), BY_ROW)


SUP = "s AS (SELECT stream_id, seq FROM b WHERE seq % 17 <> 0 UNION ALL SELECT stream_id, seq + 10000000 FROM b WHERE seq % 41 = 0 UNION ALL SELECT stream_id, seq FROM b WHERE seq % 29 = 0)"


@query("join15_key_coverage", with_(OR, SUP) + """,
c AS (SELECT stream_id, seq, count(*) AS n FROM s GROUP BY ALL)
SELECT b.stream_id, b.seq, 'missing' AS issue FROM b ANTI JOIN c ON b.stream_id = c.stream_id AND b.seq = c.seq
UNION ALL SELECT c.stream_id, c.seq, 'extra' FROM c ANTI JOIN b ON b.stream_id = c.stream_id AND b.seq = c.seq UNION ALL SELECT stream_id, seq, 'duplicate' FROM c WHERE n > 1""")
def join15(spark, sf):
    base, _ = rows(spark, sf)
    slim = base.select("stream_id", "seq")
    supplied = slim.where("seq % 17 <> 0").union(slim.where("seq % 41 = 0").select("stream_id", (seq() + 10_000_000).alias("seq"))).union(slim.where("seq % 29 = 0"))
    return ov.key_coverage(base, supplied)


REFS = "rf AS (SELECT stream_id, seq, ['r' || CAST(seq % 5 AS VARCHAR), 'r' || CAST(seq % 7 AS VARCHAR)] AS refs FROM b)"


def with_refs(base):
    return base.withColumn("refs", F.array(F.concat(L("r"), (seq() % 5).cast("string")), F.concat(L("r"), (seq() % 7).cast("string"))))


@query("join16_orphan_refs", with_(OR, REFS) + """,
al AS (SELECT c_custkey AS stream_id, 'r' || CAST(c_custkey % 5 AS VARCHAR) AS ref FROM customer UNION SELECT c_custkey, 'r' || CAST(c_custkey % 3 AS VARCHAR) FROM customer UNION SELECT c_custkey, 'r0' FROM customer)
SELECT DISTINCT u.stream_id, u.seq, u.ref FROM (SELECT stream_id, seq, unnest(refs) AS ref FROM rf) u ANTI JOIN al ON al.stream_id = u.stream_id AND al.ref = u.ref""")
def join16(spark, sf):
    base, _ = rows(spark, sf)
    c = F.col("c_custkey")
    allowed = table(spark, sf, "customer").select(c.alias("stream_id"), F.explode(F.array(F.concat(L("r"), (c % 5).cast("string")), F.concat(L("r"), (c % 3).cast("string")), L("r0"))).alias("ref"))
    return ov.orphan_refs(with_refs(base), allowed)


@query("join16_unacknowledged_conflicts", with_(OR, REFS) + """
SELECT * FROM (SELECT stream_id, seq, array_to_string(list_sort(list_distinct(list_filter(refs, lambda x: x <> 'r' || CAST(seq % 2 AS VARCHAR)))), ',') AS open_conflicts FROM rf) WHERE open_conflicts <> ''""")
def join16b(spark, sf):
    base, _ = rows(spark, sf)
    df = with_refs(base).withColumn("ack", F.array(F.concat(L("r"), (seq() % 2).cast("string"))))
    return ov.unacknowledged(df, "refs", "ack").withColumn("open_conflicts", F.array_join("open_conflicts", ","))


BAD_A = "bd AS (SELECT DISTINCT stream_id FROM b WHERE stream_id % 37 = 0 OR stream_id % 41 = 0)"


@query("join17_overlay_fields", with_(OR, BAD_A) + """
SELECT b.stream_id, b.seq, CASE WHEN bd.stream_id IS NULL AND b.seq % 3 = 0 THEN coalesce(CASE WHEN b.seq % 6 <> 0 THEN 'R' || b.seq END, b.text) ELSE b.text END AS text, CASE WHEN bd.stream_id IS NULL AND b.seq % 3 = 0 THEN 'done' ELSE b.status END AS status,
  CASE WHEN bd.stream_id IS NOT NULL THEN 'rejected' WHEN b.seq % 3 = 0 THEN 'merged' ELSE 'unchanged' END AS merge_status FROM b LEFT JOIN bd USING (stream_id)""")
def join17a(spark, sf):
    base, _ = rows(spark, sf)
    hit = base.where("seq % 3 = 0")
    reviewed = hit.select("stream_id", "seq", F.when(seq() % 6 != 0, F.concat(L("R"), seq().cast("string"))).alias("text"), L("done").alias("status"))
    first = base.groupBy("stream_id").agg(F.min("seq").alias("seq"))
    unknown = first.where("stream_id % 37 = 0").select("stream_id", (seq() + 90_000_000).alias("seq"), L("x").alias("text"), L("x").alias("status"))
    twice = first.where("stream_id % 41 = 0").select("stream_id", "seq", L("y").alias("text"), L("y").alias("status"))
    return ov.overlay_fields(base, reviewed.union(unknown).union(twice).union(twice), ["text", "status"]).select("stream_id", "seq", "text", "status", "merge_status")


@query("join17_replace_or_hold", with_(OR) + """,
bd AS (SELECT DISTINCT stream_id FROM b WHERE seq % 1000 = 500)
SELECT b.stream_id, b.seq, CASE WHEN bd.stream_id IS NOT NULL THEN 'rejected' WHEN b.seq % 4 <> 0 THEN 'unchanged' WHEN b.seq % 8 = 0 AND b.seq % 3 <> 0 THEN 'replaced' ELSE 'held' END AS method,
  CASE WHEN bd.stream_id IS NOT NULL OR b.seq % 4 <> 0 THEN b.text WHEN b.seq % 8 = 0 AND b.seq % 3 <> 0 THEN 'N' || b.seq ELSE '…' END AS text FROM b LEFT JOIN bd USING (stream_id)""")
def join17b(spark, sf):
    base, _ = rows(spark, sf)
    decisions = base.where("seq % 4 = 0 and seq % 1000 <> 500").select("stream_id", "seq", F.when(seq() % 8 == 0, "replace").otherwise("hold").alias("action"), F.concat(L(" N"), seq().cast("string"), L(" ")).alias("text"))
    reviews = base.where("seq % 4 = 0 and seq % 5 <> 0").select("stream_id", "seq", F.when(seq() % 3 == 0, "revert").otherwise("keep").alias("verdict"))
    extra = base.where("seq % 20 = 0").select("stream_id", "seq", F.when(seq() % 3 == 0, "revert").otherwise("keep").alias("verdict"))
    out = ov.replace_or_hold(base, decisions, reviews.union(extra), must_answer=seq() % 1000 == 500)
    return out.select("stream_id", "seq", "method", "text")


@query("join17_guarded_patch", with_(OR) + """,
pt AS (SELECT *, CASE WHEN seq % 8 = 0 THEN 'drop' ELSE 'replace' END AS action, CASE WHEN seq % 12 = 0 THEN end_ms + 7 END AS ne FROM b WHERE seq % 4 = 0),
bd AS (SELECT DISTINCT stream_id FROM pt WHERE seq % 700 = 0 OR coalesce(ne, end_ms) <= start_ms),
q AS (SELECT b.stream_id, b.seq, b.start_ms, CASE WHEN p.seq IS NOT NULL AND bd.stream_id IS NULL THEN coalesce(ne, b.end_ms) ELSE b.end_ms END AS end_ms, CASE WHEN p.seq IS NOT NULL AND bd.stream_id IS NULL THEN 'A' || b.seq ELSE b.text END AS text,
   CASE WHEN bd.stream_id IS NOT NULL THEN 'rejected' WHEN p.seq IS NOT NULL THEN 'patched' ELSE 'unchanged' END AS patch_status
  FROM b LEFT JOIN pt p ON p.stream_id = b.stream_id AND p.seq = b.seq LEFT JOIN bd ON bd.stream_id = b.stream_id WHERE NOT (p.seq IS NOT NULL AND bd.stream_id IS NULL AND p.action = 'drop'))
SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS new_seq FROM q""")
def join17c(spark, sf):
    base, order = rows(spark, sf)
    patches = base.where("seq % 4 = 0").select(
        "stream_id", "seq", F.when(seq() % 700 == 0, "drifted").otherwise(F.col("text")).alias("expected_before"), F.when(seq() % 8 == 0, "drop").otherwise("replace").alias("action"),
        F.concat(L("A"), seq().cast("string")).alias("after"), F.when(seq() % 12 == 0, F.col("end_ms") + 7).alias("new_end"),
    )
    return ov.guarded_patch(base, patches, order).select("stream_id", "seq", "start_ms", "end_ms", "text", "patch_status", "new_seq")


@query("join17_strict_replace", with_(OR) + """,
bd AS (SELECT DISTINCT stream_id FROM b WHERE seq % 200 = 0 OR seq % 300 = 1)
SELECT b.stream_id, b.seq, CASE WHEN bd.stream_id IS NULL THEN 'S' || b.seq ELSE b.text END AS text, bd.stream_id IS NULL AS replaced FROM b LEFT JOIN bd USING (stream_id)""")
def join17d(spark, sf):
    base, _ = rows(spark, sf)
    new = base.where("seq % 200 <> 0").select("stream_id", "seq", F.when(seq() % 300 == 1, " ").otherwise(F.concat(L("S"), seq().cast("string"))).alias("text"))
    return ov.strict_replace(base, new).select("stream_id", "seq", "text", "replaced")


@query("join18_priority_coalesce", with_(OR) + """,
x AS (SELECT DISTINCT stream_id FROM b WHERE seq % 61 = 0)
SELECT b.stream_id, b.seq, CASE WHEN x.stream_id IS NULL AND b.seq % 3 = 0 THEN 'first' WHEN b.seq % 4 = 0 THEN 'second' ELSE 'abstained' END AS origin,
  CASE WHEN x.stream_id IS NULL AND b.seq % 3 = 0 THEN 'one' || b.seq WHEN b.seq % 4 = 0 THEN 'two' || b.seq ELSE '' END AS text FROM b LEFT JOIN x USING (stream_id)""")
def join18(spark, sf):
    base, order = rows(spark, sf)
    one = base.withColumns({"text": F.when(seq() % 3 == 0, F.concat(L("one"), seq().cast("string"))).otherwise(""), "end_ms": F.col("end_ms") + F.when(seq() % 61 == 0, 1).otherwise(0)})
    two = base.withColumn("text", F.when(seq() % 4 == 0, F.concat(L("two"), seq().cast("string"))).otherwise("[unconfirmed]"))
    return ov.priority_coalesce(base, [("first", one), ("second", two)], order, reject=r"^\[unconfirmed\]").select("stream_id", "seq", "origin", "text")


@query("join19_artifact_agreement", with_(OR, OTHER, DIFF) + """
SELECT stream_id, pos, unnest(list_filter([CASE WHEN rs IS NULL OR ls IS NULL THEN 'count_mismatch' END, CASE WHEN ls <> rs THEN 'id_mismatch' END, CASE WHEN lt <> rt THEN 'text_mismatch' END,
   CASE WHEN l0 <> r0 OR l1 <> r1 THEN 'time_mismatch' END], lambda x: x IS NOT NULL)) AS code FROM fj""")
def join19(spark, sf):
    base, _ = rows(spark, sf)
    return ov.artifact_agreement(base, other(base), BY_ROW)


AFTER = "a AS (SELECT stream_id, seq, start_ms, CASE WHEN seq % 23 = 0 THEN start_ms ELSE end_ms END AS end_ms, CASE WHEN seq % 9 = 0 THEN text || '!' ELSE text END AS text FROM b WHERE seq % 19 <> 0 UNION ALL SELECT stream_id, seq + 50000000, start_ms, end_ms, text FROM b WHERE seq % 101 = 0)"


def after(base):
    kept = base.where("seq % 19 <> 0").withColumns(
        {"end_ms": F.when(seq() % 23 == 0, F.col("start_ms")).otherwise(F.col("end_ms")), "text": F.when(seq() % 9 == 0, F.concat("text", L("!"))).otherwise(F.col("text"))})
    more = base.where("seq % 101 = 0").withColumn("seq", seq() + 50_000_000)
    return kept.unionByName(more).withColumn("_chunk", F.floor(seq() / WIDTH).cast("long"))


@query("agg30_change_report", with_(OR, AFTER) + """
SELECT coalesce(b.stream_id, a.stream_id) AS stream_id, coalesce(b.seq, a.seq) AS seq, CASE WHEN a.seq IS NULL THEN 'removed' WHEN b.seq IS NULL THEN 'added' WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS change,
  coalesce(a.end_ms <= a.start_ms, false) AND NOT coalesce(b.end_ms <= b.start_ms, false) AS new_defect, sha256(a.text) AS sha256 FROM b FULL JOIN a ON a.stream_id = b.stream_id AND a.seq = b.seq""")
def agg30(spark, sf):
    base, _ = rows(spark, sf)
    return ov.change_report(base, after(base), defect=F.col("end_ms") <= F.col("start_ms"))


@query("agg30_defect_delta", with_(OR, AFTER) + """,
x AS (SELECT stream_id, count(*) FILTER (end_ms <= start_ms) AS i, count(*) FILTER (start_ms < p) AS w FROM (SELECT *, lag(start_ms) OVER (PARTITION BY stream_id ORDER BY seq) AS p FROM b) GROUP BY ALL),
y AS (SELECT stream_id, count(*) FILTER (end_ms <= start_ms) AS i, count(*) FILTER (start_ms < p) AS w FROM (SELECT *, lag(start_ms) OVER (PARTITION BY stream_id ORDER BY seq) AS p FROM a) GROUP BY ALL),
f AS (SELECT a.stream_id, count(*) AS n FROM a LEFT JOIN b ON a.stream_id = b.stream_id AND a.seq = b.seq AND b.end_ms <= b.start_ms WHERE a.end_ms <= a.start_ms AND b.seq IS NULL GROUP BY ALL)
SELECT coalesce(x.stream_id, y.stream_id) AS stream_id, x.i AS before_invalid, x.w AS before_backward, y.i AS after_invalid, y.w AS after_backward, coalesce(f.n, 0) AS new_invalid, greatest(0, y.w - x.w) AS new_backward
FROM x FULL JOIN y USING (stream_id) LEFT JOIN f USING (stream_id)""")
def agg30b(spark, sf):
    base, order = rows(spark, sf)
    return ov.defect_delta(base, after(base), order)


@query("agg30_uncertainty_report", with_(OR) + """
SELECT * FROM (SELECT stream_id, seq, array_to_string(list_filter([CASE WHEN status = 'P' THEN 'status' END, CASE WHEN seq % 4 = 0 THEN 'confidence' END, CASE WHEN seq % 7 = 0 THEN 'slots' END], lambda x: x IS NOT NULL), ',') AS why FROM b) WHERE why <> ''""")
def agg30c(spark, sf):
    base, _ = rows(spark, sf)
    none = F.array().cast("array<string>")
    df = base.withColumns({"status": F.when(F.col("status") == "P", "hold").otherwise("ok"), "confidence": F.when(seq() % 4 == 0, "low").otherwise("high"), "uncertain_slots": F.when(seq() % 7 == 0, F.array(L("s"))).otherwise(none)})
    return ov.uncertainty_report(df).withColumn("why", F.array_join("why", ","))


GRAPH = """seg AS (SELECT stream_id, seq FROM b), evd AS (SELECT l_orderkey AS seq, o.stream_id, CAST(l_partkey AS VARCHAR) AS ref FROM lineitem JOIN b o ON o.seq = l_orderkey WHERE l_returnflag <> 'R'),
dcn AS (SELECT o.stream_id, o.seq, CAST(l_partkey AS VARCHAR) AS ref FROM lineitem JOIN b o ON o.seq = l_orderkey WHERE l_quantity > 25),
hyp AS (SELECT o.stream_id, CASE WHEN o.seq % 4 = 0 THEN o.seq + 100000000 ELSE o.seq END AS seq, CAST(l_linenumber AS VARCHAR) AS hid, CAST(l_partkey AS VARCHAR) AS ref FROM lineitem JOIN b o ON o.seq = l_orderkey WHERE l_linenumber > 4),
evl AS (SELECT DISTINCT stream_id, CAST(seq % 10 AS VARCHAR) AS eid FROM b WHERE seq % 3 = 0), knw AS (SELECT DISTINCT stream_id, ref FROM evd),
nd AS (SELECT DISTINCT id, kind FROM (SELECT 'stream:' || stream_id AS id, 'stream' AS kind FROM seg UNION ALL SELECT 'timeline:' || stream_id, 'timeline' FROM seg UNION ALL SELECT 'segment:' || stream_id || ':' || seq, 'segment' FROM seg
  UNION ALL SELECT 'evidence:' || stream_id || ':' || ref, 'evidence' FROM evd UNION ALL SELECT 'decision:' || stream_id || ':' || seq, 'decision' FROM dcn UNION ALL SELECT 'evaluation:' || stream_id || ':' || eid, 'evaluation' FROM evl
  UNION ALL SELECT 'frame:' || stream_id || ':' || seq, 'frame' FROM seg WHERE seq % 5 = 0 UNION ALL SELECT 'hypothesis:' || stream_id || ':' || seq || ':' || hid, 'hypothesis' FROM hyp)),
eg AS (SELECT DISTINCT * FROM (SELECT 'stream:' || stream_id AS source, 'contains' AS relation, 'segment:' || stream_id || ':' || seq AS target FROM seg UNION ALL SELECT 'timeline:' || stream_id, 'aligned_to', 'segment:' || stream_id || ':' || seq FROM seg
  UNION ALL SELECT 'evidence:' || stream_id || ':' || ref, 'supports', 'segment:' || stream_id || ':' || seq FROM evd UNION ALL SELECT 'evidence:' || d.stream_id || ':' || d.ref, 'supports', 'decision:' || d.stream_id || ':' || d.seq FROM dcn d JOIN knw USING (stream_id, ref)
  UNION ALL SELECT 'decision:' || stream_id || ':' || seq, 'derived_from', 'segment:' || stream_id || ':' || seq FROM dcn UNION ALL SELECT 'evaluation:' || stream_id || ':' || eid, 'evaluated_by', 'stream:' || stream_id FROM evl
  UNION ALL SELECT 'frame:' || stream_id || ':' || seq, 'derived_from', 'segment:' || stream_id || ':' || seq FROM seg WHERE seq % 5 = 0
  UNION ALL SELECT 'hypothesis:' || stream_id || ':' || seq || ':' || hid, 'derived_from', 'segment:' || stream_id || ':' || seq FROM hyp SEMI JOIN seg USING (stream_id, seq)
  UNION ALL SELECT 'evidence:' || stream_id || ':' || ref, 'supports', 'hypothesis:' || stream_id || ':' || seq || ':' || hid FROM hyp JOIN knw USING (stream_id, ref)))"""


def graph_tables(spark, sf):
    base, _ = rows(spark, sf)
    seg = base.select("stream_id", "seq")
    li = table(spark, sf, "lineitem")
    items = li.select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").cast("string").alias("ref"), "l_returnflag", "l_quantity", "l_linenumber")
    parts = graph_parts(spark, sf)
    items = items.repartition(parts, "seq").join(seg.repartition(parts, "seq"), "seq")
    evidence = items.where("l_returnflag <> 'R'").select("stream_id", "seq", "ref")
    decisions = items.where("l_quantity > 25").groupBy("stream_id", "seq").agg(F.collect_set("ref").alias("refs"))
    evaluations = seg.where("seq % 3 = 0").select("stream_id", (seq() % 10).cast("string").alias("evaluation_id"))
    # a quarter of the hypotheses speak of segments that don't exist
    place = F.when(seq() % 4 == 0, seq() + 100_000_000).otherwise(seq())
    hypotheses = items.where("l_linenumber > 4").groupBy("stream_id", place.alias("seq"), F.col("l_linenumber").cast("string").alias("hypothesis_id")).agg(F.collect_set("ref").alias("refs"))
    return seg, evidence, decisions, evaluations, seg.where("seq % 5 = 0"), hypotheses


def graph_parts(spark, sf):
    """A partition for each 200,000 items; the number of rows stands in the files' footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + table(spark, sf, "lineitem").count() // 200_000)


def graph(spark, sf, distinct=True):
    return ov.lineage_graph(*graph_tables(spark, sf), parts=graph_parts(spark, sf), distinct=distinct)


@query("agg31_orphan_refs", with_(OR, GRAPH) + """SELECT DISTINCT stream_id, seq, ref, 'decision' AS location FROM dcn ANTI JOIN knw USING (stream_id, ref)
UNION ALL SELECT DISTINCT stream_id, seq, ref, 'hypothesis.supported_by' FROM hyp ANTI JOIN knw USING (stream_id, ref)""")
def agg31d(spark, sf):
    _, evidence, decisions, _, _, hypotheses = graph_tables(spark, sf)
    return ov.unknown_refs(evidence, decisions, hypotheses)


@query("agg31_lineage_nodes", with_(OR, GRAPH) + "SELECT * FROM nd")
def agg31a(spark, sf):
    return graph(spark, sf)[0]


@query("agg31_lineage_edges", with_(OR, GRAPH) + "SELECT * FROM eg")
def agg31b(spark, sf):
    return graph(spark, sf)[1]


@query("agg31_graph_orphans", with_(OR, GRAPH) + "SELECT DISTINCT e.id, e.relation FROM (SELECT source AS id, relation FROM eg UNION ALL SELECT target, relation FROM eg) e ANTI JOIN nd ON nd.id = e.id")
def agg31c(spark, sf):
    return ov.graph_orphans(*graph(spark, sf, distinct=False), parts=graph_parts(spark, sf))


@query("agg33_contract_violations", """WITH r AS (SELECT l_orderkey AS stream_id, CAST(l_linenumber AS BIGINT) AS seq, l_partkey, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE l_returnflag END AS flag, l_linestatus AS ls, l_quantity AS q, l_discount AS d FROM lineitem)
SELECT stream_id, seq, unnest(list_filter([CASE WHEN flag = '' THEN 'required:flag' END, CASE WHEN flag NOT IN ('A', 'N') THEN 'enum:flag' END, CASE WHEN NOT (ls <> 'F' OR d > 0.02) THEN 'rule:closed-needs-discount' END], lambda x: x IS NOT NULL)) AS violation FROM r
UNION ALL SELECT stream_id, seq, 'duplicate_id' FROM (SELECT *, count(*) OVER (PARTITION BY stream_id, seq) AS n FROM r) WHERE n > 1""")
def agg33(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").cast("long").alias("seq"), F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.col("l_returnflag")).alias("flag"), "l_linestatus", "l_discount",
    )
    contract = ov.Contract(
        required=("flag",), enums={"flag": ("A", "N")}, conditions=(("closed-needs-discount", (F.col("l_linestatus") != "F") | (F.col("l_discount") > 0.02)),), unique=("stream_id", "seq")
    )
    return ov.contract_violations(df, contract)


LOG = """lg AS (SELECT user_id AS stream_id, CAST(event_id % 3 AS BIGINT) AS unit_id, event_id AS line, ['pending', 'deferred', 'held', 'approved', 'rejected'][CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 + 1] AS st FROM events),
l2 AS (SELECT stream_id, unit_id, line, CASE WHEN st = 'held' THEN 'deferred' ELSE st END AS st, lag(CASE WHEN st = 'held' THEN 'deferred' ELSE st END) OVER (PARTITION BY stream_id, unit_id ORDER BY line) AS bf FROM lg),
l3 AS (SELECT *, CASE WHEN line % 7 = 0 THEN 'pending' ELSE coalesce(bf, 'pending') END AS pv FROM l2),
un AS (SELECT stream_id, unit_id, arg_max(st, line) AS status, count(*) FILTER (pv <> coalesce(bf, 'pending') OR (coalesce(bf, 'pending') IN ('approved', 'rejected') AND st <> bf) OR (coalesce(bf, '') = 'deferred' AND st NOT IN ('deferred', 'approved', 'rejected'))
   OR (coalesce(bf, '') = 'pending' AND st = 'pending')) AS breaks, count(*) AS entries FROM l3 GROUP BY ALL)"""


@query("agg37_log_fold", with_(LOG) + "SELECT *, bool_or(breaks > 0) OVER (PARTITION BY stream_id) AS log_rejected FROM un")
def agg37(spark, sf):
    from tidemark.operators.ordered import neighbour

    ev = events(spark, sf)
    status = F.get(F.array(*[L(s) for s in ("pending", "deferred", "held", "approved", "rejected")]), (F.col("k") % 5).cast("int"))
    log = ev.select("stream_id", (F.col("seq") % 3).alias("unit_id"), F.col("seq").alias("line"), status.alias("status"))
    log, order = chunked(log, Order(("stream_id", "unit_id"), ("line",)), 4000)
    clean = F.when(F.col("status") == "held", "deferred").otherwise(F.col("status"))
    log = neighbour(log, order, {"_b": clean})
    log = log.withColumn("previous_status", F.when(F.col("line") % 7 == 0, "pending").otherwise(F.coalesce("_b", L("pending")))).drop("_b")
    return ov.fold_log(log, order)


@query("agg38_packaging", with_(OR) + """,
bd AS (SELECT DISTINCT stream_id FROM b WHERE seq % 500 = 0)
SELECT b.stream_id, b.seq, CASE WHEN bd.stream_id IS NOT NULL THEN 'incomplete' WHEN b.seq % 6 <> 0 AND (b.seq % 2 = 0 OR status = 'F') AND status <> 'O' AND b.seq % 11 <> 0 THEN 'candidate' ELSE 'held' END AS package_state FROM b LEFT JOIN bd USING (stream_id)""")
def agg38(spark, sf):
    return packaged(spark, sf).select("stream_id", "seq", "package_state")


def packaged(spark, sf):
    base, _ = rows(spark, sf)
    none = F.array().cast("array<string>")
    units = base.select(
        "stream_id", "seq", F.when(seq() % 6 == 0, none).otherwise(F.array(L("r"))).alias("refs"), F.when(seq() % 2 == 0, "trusted").otherwise("suspect").alias("quality"),
        F.when(F.col("status") == "F", "approved").when(F.col("status") == "O", "rejected").otherwise("pending").alias("review_status"), (seq() % 11 != 0).alias("gates_passed"),
    )
    texts = base.where("seq % 500 <> 0").select("stream_id", "seq", F.col("text").alias("faithful"), F.col("text").alias("natural"))
    return ov.package_units(units, texts)


@query("agg38_package_counts", with_(OR) + """,
bd AS (SELECT DISTINCT stream_id FROM b WHERE seq % 500 = 0),
s AS (SELECT b.stream_id, CASE WHEN bd.stream_id IS NOT NULL THEN 'incomplete' WHEN b.seq % 6 <> 0 AND (b.seq % 2 = 0 OR status = 'F') AND status <> 'O' AND b.seq % 11 <> 0 THEN 'candidate' ELSE 'held' END AS p FROM b LEFT JOIN bd USING (stream_id))
SELECT stream_id, count(*) FILTER (p = 'candidate') AS candidate, count(*) FILTER (p = 'held') AS held, count(*) FILTER (p = 'incomplete') AS incomplete FROM s GROUP BY stream_id""")
def agg38b(spark, sf):
    return ov.package_counts(packaged(spark, sf))


@query("agg39_unreviewed_risk", with_(OR) + """
SELECT * FROM (SELECT stream_id, seq, array_to_string(list_filter([CASE WHEN seq % 4 = 0 THEN 'low_confidence' END, CASE WHEN status = 'P' THEN 'abstained' END, CASE WHEN seq % 9 = 0 THEN 'risk' END, CASE WHEN seq % 13 = 0 THEN 'inferred' END,
  CASE WHEN seq % 17 = 0 THEN 'competing' END], lambda x: x IS NOT NULL), ',') AS why FROM b WHERE seq % 5 <> 1) WHERE why <> ''""")
def agg39(spark, sf):
    base, _ = rows(spark, sf)
    none = F.array().cast("array<string>")
    d = base.select("stream_id", "seq", F.when(seq() % 4 == 0, "low").otherwise("high").alias("confidence"), F.when(F.col("status") == "P", "abstained").otherwise("accepted").alias("status"),
                    F.when(seq() % 9 == 0, F.array(L("x"))).otherwise(none).alias("risk_codes"), (seq() % 13 == 0).alias("inferred"), (seq() % 17 == 0).alias("competing"))
    return ov.unreviewed_risk(d, base.where("seq % 5 = 1")).withColumn("why", F.array_join("why", ","))


@query("agg39_totals_reconcile", with_(OR) + """,
r AS (SELECT stream_id, count(*) AS rows, count(*) FILTER (status = 'F') AS accepted, count(*) FILTER (status = 'P') AS abstained FROM b GROUP BY ALL)
SELECT stream_id, rows, accepted, abstained, rows + CASE WHEN stream_id % 10 = 0 THEN 1 ELSE 0 END AS report_rows, accepted AS report_accepted, abstained AS report_abstained, stream_id % 10 <> 0 AS reconciled FROM r WHERE stream_id % 15 <> 0
UNION ALL SELECT stream_id, rows, accepted, abstained, NULL, NULL, NULL, false FROM r WHERE stream_id % 15 = 0""")
def agg39b(spark, sf):
    base, _ = rows(spark, sf)
    d = base.withColumn("status", F.when(F.col("status") == "F", "accepted").when(F.col("status") == "P", "abstained").otherwise("open"))
    c = lambda s: F.count(F.when(F.col("status") == s, 1))
    report = d.where("stream_id % 15 <> 0").groupBy("stream_id").agg(F.count("*").alias("rows"), c("accepted").alias("accepted"), c("abstained").alias("abstained"))
    report = report.withColumn("rows", F.col("rows") + F.when(F.col("stream_id") % 10 == 0, 1).otherwise(0))
    return ov.reconcile_totals(d, report)


@query("agg40_two_context_proposals", with_(OR) + """
SELECT stream_id, seq, CASE WHEN seq % 3 = 0 AND seq % 6 <> 0 THEN 'replace' ELSE 'review' END AS proposal, CASE WHEN seq % 3 = 0 AND seq % 6 <> 0 THEN 'new ' || seq ELSE text END AS text FROM b""")
def agg40(spark, sf):
    base, _ = rows(spark, sf)
    core = base.where("seq % 3 = 0").select("stream_id", "seq", L("core").alias("window"), F.concat(L("new "), seq().cast("string")).alias("text"))
    ctx = base.where("seq % 3 = 0").select("stream_id", "seq", L("context").alias("window"), F.when(seq() % 6 == 0, "else").otherwise(F.concat(L(" new  "), seq().cast("string"))).alias("text"))
    return ov.two_context_proposals(base, core.union(ctx)).select("stream_id", "seq", "proposal", "text")


@query("agg41_confirmed_profiles", """WITH p AS (SELECT c_nationkey AS stream_id, c_mktsegment AS speaker_id, c_custkey AS profile_id FROM customer WHERE c_custkey % 50 < 3)
SELECT stream_id, speaker_id, count(*) AS confirmed_rows, CASE WHEN count(*) = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN count(*) = 1 THEN min(profile_id) END AS profile_id FROM p SEMI JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) s ON s.s_nationkey = p.stream_id
WHERE speaker_id IN ('BUILDING', 'MACHINERY') GROUP BY ALL""")
def agg41(spark, sf):
    prof = table(spark, sf, "customer").select(F.col("c_nationkey").alias("stream_id"), F.col("c_mktsegment").alias("speaker_id"), F.col("c_custkey").alias("profile_id"), F.when(F.col("c_custkey") % 50 < 3, "confirmed").otherwise("draft").alias("status"))
    wanted = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("stream_id"), F.explode(F.array(L("BUILDING"), L("MACHINERY"))).alias("speaker_id"))
    return ov.confirmed_profiles(prof, wanted)


@query("agg42_effect_report", with_(OR) + """
SELECT stream_id, count(*) AS compared, count(*) FILTER (seq % 9 = 0) AS changed, count(*) FILTER (seq % 4 = 0) AS low_before, count(*) FILTER (seq % 8 = 0) AS low_after, count(*) FILTER (status = 'P') AS critical FROM b GROUP BY stream_id""")
def agg42(spark, sf):
    base, _ = rows(spark, sf)
    before = base.select("stream_id", "seq", "text", F.when(seq() % 4 == 0, "low").otherwise("high").alias("confidence"))
    now = base.select("stream_id", "seq", F.when(seq() % 9 == 0, F.concat("text", L("?"))).otherwise(F.col("text")).alias("text"), F.when(seq() % 8 == 0, "low").otherwise("high").alias("confidence"), F.when(F.col("status") == "P", "critical").otherwise("minor").alias("severity"))
    return ov.effect_report(before, now)
