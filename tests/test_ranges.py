"""Searches over positions, ledger ranges, declared slots, file roles and content checks against brute force."""

import json
import random

from pyspark.sql import functions as F

from tidemark.operators import evidence as ev
from tidemark.operators import rollups as ru
from tidemark.operators import sampling as sm
from tidemark.operators.intervals import offset_gate, recoverable
from tidemark.operators.ordered import Order, next_greater
from tidemark.sources import files as fs

SEQ = Order(by=("seq",))


def test_next_greater_over_all_following_rows(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.choice([5, 5, 7, 10, 20, i, 90 - i])) for s in range(4) for i in range([1, 40, 90, 17][s])]
    df = spark.createDataFrame(rows, "stream_id long, seq long, v long")
    for fan in (3, 64):
        got = {(r.stream_id, r.seq): r.later for r in next_greater(df, SEQ, "v", F.col("seq") % 3 != 1, "later", fan).collect()}
        for s, i, v in rows:
            after = [w for q, j, w in rows if q == s and j > i and w > v]
            assert got[s, i] == (after[0] if after and i % 3 != 1 else None), (s, i)


def test_ledger_ranges_by_blocks(spark):
    rng = random.Random(8)
    scopes = ["title", "temporary", "scene", "speaker", "relationship", "other"]
    entries = []
    for i in range(60):
        low, high = rng.choice([None, rng.randrange(-3, 320)]), rng.choice([None, rng.randrange(0, 340)])
        entries.append((i % 2, i, "term", rng.choice(scopes), f"k{i % 5}", f"v{i % 3}", rng.choice(["confirmed", "candidate", "retired"]), rng.sample(["a", "b", "c", None], 2), rng.choice(["p", "q", None]), rng.choice(["p", None]), low, high))
    segments = [(s, n, rng.sample(["a", "b", "x"], rng.randrange(0, 3))) for s in (0, 1) for n in range(0, 300, 3)]
    speakers = [(s, n, rng.choice(["p", "q", None]), rng.choice(["p", None]), rng.random() < 0.7) for s, n, _ in segments]
    ledger = spark.createDataFrame(entries, "stream_id long, entry_id long, entry_type string, scope string, key string, value string, status string, scene_ids array<string>, speaker_id string, addressee_id string, start_block long, end_block long")
    got = ev.apply_ledger(ledger, spark.createDataFrame(segments, "stream_id long, seq long, scene_ids array<string>"), spark.createDataFrame(speakers, "stream_id long, seq long, speaker_id string, addressee_id string, trusted boolean"))
    got = sorted((r.stream_id, r.seq, r.entry_id) for r in got.collect())
    who = {(s, n): (sp, ad) for s, n, sp, ad, ok in speakers if ok}
    want = []
    for s, n, scenes in segments:
        for e in entries:
            if e[0] != s or e[6] == "retired" or (e[10] is not None and n < e[10]) or (e[11] is not None and n > e[11]):
                continue
            speaker = who.get((s, n))
            fits = {"title": True, "temporary": True, "scene": bool({x for x in e[7] if x} & set(scenes)), "speaker": speaker is not None and e[8] is not None and speaker[0] == e[8],
                    "relationship": speaker is not None and speaker == (e[8], e[9])}.get(e[3], False)
            if fits:
                want.append((s, n, e[1]))
    assert got == sorted(want)


LEDGER = "stream_id long, entry_id long, entry_type string, scope string, key string, value string, status string, scene_ids array<string>, speaker_id string, addressee_id string, start_block long, end_block long"


def ledger_case(spark, seed):
    """Ranges and positions on both sides of zero, bounds beyond all segments; the rows that must come."""
    rng = random.Random(seed)
    bound = lambda: rng.choice([None, None, -21, 10, 11, -(10**12), 10**12])
    entries = [
        (i % 3, i, rng.choice(["term", "tone"]), rng.choice(["title", "scene", "speaker", "relationship"]), "k", rng.choice(["v", "w", None]), rng.choice(["confirmed", "confirmed", "candidate", "retired"]),
         rng.sample(["a", "b", "c", None], 2), rng.choice(["p", "q", None]), rng.choice(["p", None]), bound(), bound()) for i in range(400)
    ]
    segments = [(s, n, rng.choice([[], ["a"], ["a", "b"]])) for s in (0, 1) for n in range(-60, 80)]
    speakers = [(s, n, rng.choice(["p", None]), rng.choice(["p", None]), rng.random() < 0.7) for s, n, _ in segments]
    who = {(s, n): (sp, ad) for s, n, sp, ad, ok in speakers if ok}
    want = []
    for s, n, scenes in segments:
        said, hits, found = who.get((s, n)), [], {}
        for e in entries:
            fits = {"title": True, "scene": bool({x for x in e[7] if x} & set(scenes)), "speaker": said is not None and e[8] is not None and said[0] == e[8], "relationship": said == (e[8], e[9])}[e[3]]
            if e[0] == s and e[6] != "retired" and fits and (e[10] is None or n >= e[10]) and (e[11] is None or n <= e[11]):
                hits.append(e)
                if e[6] == "confirmed" and e[5]:
                    found.setdefault((e[2:5], e[8:10]), set()).add(e[5])
        for e in hits:
            use = "unresolved" if e[6] == "candidate" else "withheld_conflict" if len(found.get((e[2:5], e[8:10]), ())) > 1 else "applied"
            want.append((s, n, *e[1:5], e[5] or "", use))
    frames = (spark.createDataFrame(entries, LEDGER), spark.createDataFrame(segments, "stream_id long, seq long, scene_ids array<string>"),
              spark.createDataFrame(speakers, "stream_id long, seq long, speaker_id string, addressee_id string, trusted boolean"))
    return frames, sorted(want)


def test_ledger_meets_classes_of_segments(spark):
    frames, want = ledger_case(spark, 5)
    assert {w[-1] for w in want} == {"applied", "withheld_conflict", "unresolved"}
    rows, classes = ev.ledger_classes(*frames)
    # segments that nothing tells apart are matched once, and any size of tile gives the same rows
    assert rows.count() < 0.8 * len(want) and classes.count() == 280
    for tile in (2, 1000):
        got = ev.spread(rows, classes, tile=tile, made=100)
        assert sorted((*r[:6], r.value or "", r.use) for r in got.collect()) == want


def test_ledger_is_joined_without_broadcasts(spark):
    frames, want = ledger_case(spark, 6)
    got = ev.apply_ledger(*frames)
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    assert sorted((*r[:6], r.value or "", r.use) for r in got.collect()) == want


def test_one_large_class_is_many_tasks(spark):
    rows = spark.createDataFrame([(1, 7, i) for i in range(300)], "stream_id long, seq long, entry_id long")
    classes = spark.createDataFrame([(1, i, 7) for i in range(7, 407)], "stream_id long, seq long, _first long")
    got = ev.spread(rows, classes, tile=40, made=8_000)
    per = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 300 * 400 == got.distinct().count() and len(per) > 8 and max(per) < 0.25 * sum(per), per


def test_consistency_reasons_of_classes_are_those_of_segments(spark):
    frames, _ = ledger_case(spark, 7)
    rows, classes = ev.ledger_classes(*frames)
    each = sm.consistency_reasons(ev.spread(rows, classes), weighty=("tone",))
    once = ev.spread(sm.consistency_reasons(rows, weighty=("tone",)), classes)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, each.select(once.columns).collect())) != []


def test_slot_conflicts_read_any_json(spark):
    claim = lambda v, s="confirmed": {"value": v, "state": s, "by": ["x"]}
    rows = [
        (1, json.dumps({"actor": claim("a"), "mood": claim("m")})), (1, json.dumps({"actor": claim(" b "), "mood": claim("n"), "target": claim("t")})),
        (1, json.dumps({"target": claim("u", "unknown")})), (1, "{broken"), (1, None), (1, "[1]"), (2, json.dumps({"actor": claim("a")})), (2, json.dumps({"actor": claim("a ")})),
        (3, json.dumps({"actor": "bare", "polarity": claim(None)})), (3, json.dumps({"actor": claim("a"), "polarity": claim("")})),
        (4, json.dumps({"speaker": claim(1), "location": claim("x")})), (4, json.dumps({"speaker": claim(2), "location": claim("y")})),
    ]
    df = spark.createDataFrame([(0, s, j) for s, j in rows], "stream_id long, scene long, slots string")
    assert {r.scene: r.conflicts for r in ev.slot_conflicts(df).collect()} == {1: ["actor"], 4: ["location", "speaker"]}


def test_content_is_compared_however_it_is_cut(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdé 日") for _ in range(9000))

    def cut(s, whole, size):
        return [(s, i, i * 10, i * 10 + 5, whole[i * size:(i + 1) * size]) for i in range(-(-len(whole) // size))]

    swapped = text[:4000] + text[4001] + text[4000] + text[4002:]
    one = cut(1, text, 37) + cut(2, text, 4000) + cut(3, text, 50) + [(4, 0, 0, 5, " ")]
    two = cut(1, text, 1500) + cut(2, swapped, 4000) + cut(3, text[:-1], 50) + [(4, 0, 0, 5, "")]
    schema = "stream_id long, seq long, start_ms long, end_ms long, text string"
    prints = [{r.stream_id: (r._n, r._h) for r in ru.content_prints(spark.createDataFrame(x, schema), SEQ, 100).collect()} for x in (one, two)]
    assert prints[0][1] == prints[1][1] and prints[0][2] != prints[1][2] and prints[0][3] != prints[1][3] and 4 not in prints[0]


def test_assets_are_listed_without_reading_them(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHi\n")
    (tmp_path / "s1" / "a.png").write_bytes(b"\x89PNG" * 10)
    roles = [("text", r"\.srt$"), ("frame", r"\.png$")]
    full = {r.role: r for r in fs.file_manifest(spark, str(tmp_path), roles, r"/(s\d)/", ["text"]).collect()}
    assert full["text"].blocks == 1 and full["text"].first_clock == "00:00:01,000" and full["frame"].blocks is None and full["frame"].size == 40 and full["frame"].sha256
    assets = fs.file_manifest(spark, str(tmp_path), roles, r"/(s\d)/", [], digest=False)
    plan = assets._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0] and {r.sha256 for r in assets.collect()} == {None}


def test_stream_gate_and_fit_rivals(spark):
    mapped = spark.createDataFrame([(1, 1, 10, 20, "mapped"), (1, 2, -5, 4, "mapped"), (2, 1, 10, 20, "mapped"), (3, 1, None, None, "unresolved"), (4, 1, 90, 200, "mapped")],
                                   "stream_id long, seq long, mapped_start long, mapped_end long, status string")
    media = spark.createDataFrame([(2, 100), (4, 100)], "stream_id long, duration_ms long")
    table = spark.createDataFrame([(s, 0, 50, 5) for s in (1, 2)], "stream_id long, lo long, hi long, offset_ms long")
    anchors = spark.createDataFrame([(2, 50, 55), (1, 10, 99)], "stream_id long, at_ms long, media_ms long")
    got = {r.stream_id: (r.status, r.mapped_rows, r.reasons) for r in offset_gate(mapped, media, anchors, table, 10).collect()}
    assert got == {1: ("unresolved", 1, ["mapped_start_negative", "anchor_off_map"]), 2: ("resolved", 1, []), 3: ("unresolved", 0, ["unmapped_rows"]), 4: ("unresolved", 0, ["mapped_end_past_media"])}
    rivals = [("fine words", 900, 0, 900), ("x", 900, 0, 900), ("no span", None, 0, 900), ("empty span", 0, 0, 900), ("too long", 900, 0, 9000), ("hahahahahaha", 900, 0, 900)]
    df = spark.createDataFrame(rivals, "text string, span_ms long, start_ms long, end_ms long")
    assert [r.text for r in df.where(recoverable()).collect()] == ["fine words"]


def test_reasons_rank_the_queue(spark):
    rows = [(1, 1, "accepted", "high", [], None, ["e"]), (1, 2, " HOLD", "high", None, None, ["e"]), (1, 3, "accepted", None, ["actor"], ["r"], None)]
    decisions = spark.createDataFrame(rows, "stream_id long, seq long, status string, confidence string, uncertain_slots array<string>, risk_codes array<string>, evidence_refs array<string>")
    queue = {r.seq: (r.rank, r.priority, r.reason_codes) for r in sm.review_queue(sm.decision_reasons(decisions)).collect()}
    assert queue == {2: (1, "critical", ["decision-status"]), 3: (2, "high", ["low-evidence-strength", "missing-evidence-refs", "uncertain-slots", "unresolved-risk-or-alternative"])}
