"""Chunked running values and block-wise greedy scans against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import sequences as sq
from tidemark.operators.ordered import Order, chunked, context, fold_rows, islands, neighbour, overlap_islands, position, running


def make_rows(n=400, streams=3, hot=True, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = 0 if hot and rng.random() < 0.6 else rng.randrange(streams)
        start = rng.randrange(0, 20_000)
        rows.append((s, i, start, start + rng.randrange(-5, 400), rng.choice(["a b", "A b", "c", "", "dd ee ff"]), rng.choice(["x", "y"])))
    return rows


SCHEMA = "stream_id long, seq long, start_ms long, end_ms long, text string, family string"


@pytest.fixture(scope="module")
def rows(spark):
    data = make_rows()
    return data, spark.createDataFrame(data, SCHEMA).repartition(4).cache()


def by_stream(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[0], r[2], r[3], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [None, 300, 5000])
def test_running_values_match_python(rows, width):
    data, df = rows
    order = Order()
    if width:
        df, order = chunked(df, order, width)
    out = running(df, order, {"mx": ("max", F.col("end_ms")), "sm": ("sum", F.lit(2)), "la": ("last", F.when(F.col("text") != "", F.col("text")))})
    out = running(out, order, {"nx": ("min", F.col("end_ms"))}, inclusive=True, reverse=True)
    got = {(r.stream_id, r.seq): (r.mx, r.sm, r.la, r.nx) for r in out.collect()}
    for s, rs in by_stream(data).items():
        for i, r in enumerate(rs):
            past = rs[:i]
            texts = [p[4] for p in past if p[4]]
            expect = (max((p[3] for p in past), default=None), 2 * i, texts[-1] if texts else None, min(p[3] for p in rs[i:]))
            assert got[(s, r[1])] == expect


@pytest.mark.parametrize("width", [None, 700])
def test_neighbours_positions_islands(rows, width):
    data, df = rows
    order = Order()
    if width:
        df, order = chunked(df, order, width)
    out = neighbour(df, order, {"ps": F.col("seq"), "pt": F.when(F.col("seq") % 3 == 0, F.col("text"))})
    out = neighbour(out, order, {"ns": F.col("seq")}, following=True)
    out = overlap_islands(position(out, order), order, 50, "isl")
    got = {(r.stream_id, r.seq): (r.ps, r.pt, r.ns, r.pos, r.isl) for r in out.collect()}
    for s, rs in by_stream(data).items():
        reach, isl = None, 0
        for i, r in enumerate(rs):
            if reach is None or r[2] > reach + 50:
                isl += 1
            reach = r[3] if reach is None else max(reach, r[3])
            prev = rs[i - 1] if i else None
            expect = (prev and prev[1], prev[4] if prev and prev[1] % 3 == 0 else None, rs[i + 1][1] if i + 1 < len(rs) else None, i + 1, isl)
            assert got[(s, r[1])] == expect


def test_context_blocks(rows):
    data, df = rows
    out = context(df, Order(), F.col("seq"), 2, 3, block=7)
    got = {(r.stream_id, r.seq): (list(r.before), list(r.after)) for r in out.collect()}
    for s, rs in by_stream(data).items():
        ids = [r[1] for r in rs]
        for i, q in enumerate(ids):
            assert got[(s, q)] == (ids[max(0, i - 2):i], ids[i + 1:i + 4])


@pytest.mark.parametrize("max_rows", [1_000_000, 100, 16])
@pytest.mark.parametrize("width", [None, 900])
def test_greedy_scan_is_exact_in_blocks(rows, max_rows, width):
    data, df = rows
    order = Order()
    if width:
        df, order = chunked(df, order, width)

    def step(state, start, end):
        if state is None or end - state > 900:
            return start, (True,)
        return state, (False,)

    out = fold_rows(df, order, ["start_ms", "end_ms"], step, T.StructType([T.StructField("new", T.BooleanType())]), max_rows)
    got = {(r.stream_id, r.seq): r.new for r in out.collect()}
    assert len(got) == len(data)
    for s, rs in by_stream(data).items():
        state = None
        for r in rs:
            state, (new,) = step(state, r[2], r[3])
            assert got[(s, r[1])] == new


def test_partitioning_does_not_change_results(rows):
    _, df = rows
    a, order = chunked(df, Order(), 500)
    one = islands(a.coalesce(1), order, F.col("text") == "c").select("seq", "island").collect()
    two = islands(a.repartition(9, "text"), order, F.col("text") == "c").select("seq", "island").collect()
    assert sorted(one) == sorted(two)


def test_scans_see_whole_groups_of_a_union(spark):
    names = ("spark.sql.unionOutputPartitioning", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("true", "-1", "2mb", "false")):
            spark.conf.set(n, v)
        cuts = spark.range(600_000).select((F.col("id") % 3000).alias("stream_id"), (F.floor(F.col("id") / 3000) % 100).alias("at_ms"))
        streams = cuts.select("stream_id").distinct().withColumn("duration_ms", F.lit(100).cast("long"))
        got = sq.snap_windows(cuts, streams, low_ms=24, aim_ms=26, high_ms=28, overlap_ms=2)
        # a candidate at every millisecond: each window ends at its aim, and the next begins 2 before
        ends = got.groupBy("stream_id").agg(F.array_sort(F.collect_list("core_end")).alias("ends")).groupBy("ends").count()
        assert [(list(r.ends), r["count"]) for r in ends.collect()] == [([26, 50, 74, 100], 3000)]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
