"""Ordered work inside a stream without ever needing the whole stream in one task.

A plain ``Window.partitionBy(stream)`` sorts a stream in one task, so one stream
holding a third of the rows would hold up the job.  Here a stream may be cut into
chunks (any column that grows with the order: a day, a position block).  Running
values are computed per ``(stream, chunk)``; each chunk also yields one total, the
short table of totals is scanned per stream, and the carry is joined back on the
columns the rows are already partitioned by, so the rows shuffle once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialise


@dataclass(frozen=True)
class Order:
    """How rows are keyed, totally ordered and (optionally) chunked."""

    keys: tuple[str, ...] = ("stream_id",)
    by: tuple[str, ...] = ("start_ms", "end_ms", "seq")
    chunk: str | None = None

    @property
    def part(self) -> tuple[str, ...]:
        return self.keys + ((self.chunk,) if self.chunk else ())

    def window(self, reverse: bool = False):
        cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.by]
        return Window.partitionBy(*self.part).orderBy(*cols)


SEQ = Order(by=("seq",))
TIME = Order()


def chunked(df: DataFrame, order: Order, width: int, on: str | None = None) -> tuple[DataFrame, Order]:
    """Add a chunk column ``floor(on / width)``; ``on`` must be the first order column."""
    on = on or order.by[0]
    if on != order.by[0]:
        raise ValueError("chunks must follow the first order column")
    return (
        df.withColumn("_chunk", F.floor(F.col(on) / F.lit(width)).cast("long")),
        replace(order, chunk="_chunk"),
    )


def chunk_width(df: DataFrame, order: Order, rows_per_chunk: int = 1_000_000) -> int:
    """Chunk width for the densest stream, from one partial-aggregated pass (one row back)."""
    on = order.by[0]
    per = df.groupBy(*order.keys).agg(
        F.count("*").alias("n"), (F.max(on) - F.min(on) + 1).cast("double").alias("span")
    )
    top = per.agg(F.max_by("span", "n").alias("span"), F.max("n").alias("n")).first()
    if not top or not top["n"]:
        return 1
    return max(1, int(top["span"] * rows_per_chunk / max(top["n"], rows_per_chunk)))


_AGG: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def running(
    df: DataFrame,
    order: Order,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``last`` (last non-null) over the rows before each row."""
    window = order.window(reverse).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def fill(kind: str, col: Column) -> Column:
        return F.coalesce(col, F.lit(0)) if kind == "sum" else col

    if not order.chunk:
        return df.withColumns({n: fill(k, _AGG[k](e).over(window)) for n, (k, e) in values.items()})

    totals = []
    for name, (kind, expr) in values.items():
        if kind == "last":
            pick = F.min if reverse else F.max
            tagged = F.struct(*[F.col(c) for c in order.by], expr.alias("_v"))
            totals.append(pick(F.when(expr.isNotNull(), tagged))["_v"].alias(f"_t_{name}"))
        else:
            totals.append(_AGG[kind](expr).alias(f"_t_{name}"))
    across = F.col(order.chunk).desc() if reverse else F.col(order.chunk).asc()
    before = Window.partitionBy(*order.keys).orderBy(across).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*order.part).agg(*totals).select(
        *order.part, *[_AGG[k](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (k, _) in values.items()]
    )
    local = df.withColumns({f"_l_{n}": _AGG[k](e).over(window) for n, (k, e) in values.items()})
    joined = local.join(carry, list(order.part), "left")
    out = []
    for name, (kind, _) in values.items():
        here, past = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            out.append((F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))).alias(name))
        elif kind in ("max", "min"):
            out.append((F.greatest if kind == "max" else F.least)(here, past).alias(name))
        else:
            out.append(F.coalesce(here, past).alias(name))
    kept = [c for c in df.columns if c not in values]
    return joined.select(*kept, *out)


def neighbour(df: DataFrame, order: Order, values: dict[str, Column], following: bool = False) -> DataFrame:
    """Values of the previous (or following) row; null where there is none."""
    row = F.struct(*[e.alias(n) for n, e in values.items()])
    df = running(df, order, {"_near": ("last", row)}, reverse=following)
    return df.withColumns({n: F.col("_near")[n] for n in values}).drop("_near")


def position(df: DataFrame, order: Order, name: str = "pos") -> DataFrame:
    """Dense 1-based position inside the stream."""
    return running(df, order, {name: ("sum", F.lit(1).cast("long"))}, inclusive=True)


def islands(df: DataFrame, order: Order, starts: Column, name: str = "island") -> DataFrame:
    """1-based island number: grows at every row where ``starts`` holds."""
    return running(df, order, {name: ("sum", F.when(starts, 1).otherwise(0).cast("long"))}, inclusive=True)


def overlap_islands(df: DataFrame, order: Order, tolerance_ms: int = 0, name: str = "island") -> DataFrame:
    """Islands of rows whose start is within ``tolerance_ms`` of the furthest end so far."""
    df = running(df, order, {"_reach": ("max", F.col("end_ms"))})
    fresh = F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach") + tolerance_ms)
    return islands(df, order, fresh, name).drop("_reach")


def context(df: DataFrame, order: Order, value: Column, k_before: int, k_after: int, block: int = 4096) -> DataFrame:
    """``before``/``after`` arrays of up to k neighbours, on evenly sized position blocks.

    Rows near a block edge are copied to the next block, so no task sees more than
    ``block + k_before + k_after`` rows of a stream.
    """
    df = position(df, order, "_pos").withColumn("_val", value)
    home = F.floor((F.col("_pos") - 1) / block)
    low = F.floor((F.col("_pos") - 1 - k_after) / block)
    high = F.floor((F.col("_pos") - 1 + k_before) / block)
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.sequence(F.greatest(low, F.lit(0)), high))
    )
    w = Window.partitionBy(*order.keys, "_block").orderBy("_pos")
    spread = spread.withColumns(
        {
            "before": F.collect_list("_val").over(w.rowsBetween(-k_before, -1)),
            "after": F.collect_list("_val").over(w.rowsBetween(1, k_after)),
        }
    )
    return spread.where("_block = _home").drop("_pos", "_val", "_home", "_block")


def next_greater(df: DataFrame, order: Order, value: str, wanted: Column, name: str, fan: int = 64) -> DataFrame:
    """For ``wanted`` rows, the first value after the row, in order, that is strictly greater; null where there is none.

    The rows need not rise.  Positions form a tree of blocks, ``fan`` to a parent, each with its largest value.  A row looks at the later
    siblings of its block, then of the block above, and so on; the first block with a greater value is followed down.
    Every step is an equi-join on (keys, parent), so a stream is as many groups as it has parents.
    """
    keys = list(order.keys)
    df = materialise(position(df, order, "_p"), "next-rows")
    rows = df.select(*keys, (F.col("_p") - 1).alias("i"), F.col(value).alias("top"))
    seek = materialise(df.where(wanted).select(*keys, (F.col("_p") - 1).alias("row"), F.col(value).alias("v")), "next-seek")
    if seek.isEmpty():
        return df.drop("_p").withColumn(name, F.lit(None).cast(df.schema[value].dataType))
    levels, last = [rows], rows.agg(F.max("i")).first()[0]
    while last >= fan:
        levels.append(materialise(levels[-1].groupBy(*keys, F.floor(F.col("i") / fan).alias("i")).agg(F.max("top").alias("top")), "next-level"))
        last //= fan

    def first_block(asked: DataFrame, level: DataFrame, after: Column) -> DataFrame:
        below = level.select(*keys, F.floor(F.col("i") / fan).alias("parent"), "i", "top")
        hit = asked.join(below, [*keys, "parent"]).where(after & (F.col("top") > F.col("v")))
        return materialise(hit.groupBy(*keys, "row", "v").agg(F.min("i").alias("hit")), "next-hit")

    found, seek = [], seek.withColumn("at", F.col("row"))
    for level in levels:
        found.append(first_block(seek.withColumn("parent", F.floor(F.col("at") / fan)), level, F.col("i") > F.col("at")))
        seek = materialise(seek.join(found[-1].select(*keys, "row"), [*keys, "row"], "left_anti").withColumn("at", F.floor(F.col("at") / fan)), "next-seek")
    down = found.pop()
    while found:
        lower = first_block(down.withColumn("parent", F.col("hit")), levels[len(found) - 1], F.lit(True))
        down = found.pop().unionByName(lower)
    told = down.join(rows, (F.col("hit") == F.col("i")) & _same(down, rows, keys)).select(*[down[k] for k in keys], (down["row"] + 1).alias("_p"), F.col("top").alias(name))
    return df.join(told, [*keys, "_p"], "left").drop("_p")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


# --- greedy scans: each decision depends on the one before -------------------------------

Step = Callable[..., tuple[object, tuple]]


def _scan(df: DataFrame, order: Order, inputs: Sequence[str], step: Step, outputs: T.StructType, entry: str | None):
    """Sort each partition by key and order and fold ``step`` over its rows."""
    keys = list(order.part)
    names = list(dict.fromkeys([*keys, *inputs, *([entry] if entry else [])]))
    passed = [c for c in df.columns if c != entry]
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in outputs.fields]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            made: list[list] = [[] for _ in fields]
            at = {n: i for i, n in enumerate(names)}
            for row in zip(*columns):
                key = row[: len(keys)]
                if key != current:
                    current, state = key, None
                    if entry and row[at[entry]] is not None:
                        state = _decode(row[at[entry]])
                state, values = step(state, *[row[at[n]] for n in inputs])
                values = values if len(values) == len(fields) else (*values, _encode(state))
                for bucket, value in zip(made, values):
                    bucket.append(value)
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in passed]
            arrays += [pa.array(m, type=f.type) for m, f in zip(made, fields)]
            yield pa.RecordBatch.from_arrays(arrays, names=passed + [f.name for f in fields])

    schema = T.StructType([df.schema[c] for c in passed] + list(outputs.fields))
    by = [c for c in order.by if c not in keys]
    # a hash of the keys: Spark leaves out a repartition on columns that a union seems to be hashed on (see session.plain_unions)
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *by).mapInArrow(fold, schema)


def _encode(state: object) -> str:
    import json

    return json.dumps(state, ensure_ascii=False)


def _decode(text: str) -> object:
    import json

    return json.loads(text)


def fold_rows(
    df: DataFrame,
    order: Order,
    inputs: Sequence[str],
    step: Step,
    outputs: T.StructType,
    max_rows: int = 1_000_000,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Append columns made by a sequential ``step(state, *inputs) -> (state, outputs)``.

    Key groups with at most ``max_rows`` rows are folded in one go.  Larger groups are cut
    into position blocks that all run in parallel from a guessed (fresh) entry state; blocks
    whose true entry state turns out different are run again until nothing changes.  Block 0
    is right from the start and block r after r rounds, so the result is always exact; greedy
    rules that forget their past settle after a round or two.

    ``count_from`` may name a cheaper table with the same keys to count group sizes on.  Rows of a
    chunked order are written to the shared folder once, because the running values that usually
    follow read them twice and the Python scan should not run twice.
    """
    base = replace(order, chunk=None)
    big = (count_from if count_from is not None else df).groupBy(*order.keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows)
    if big.isEmpty():
        done = _scan(df, base, inputs, step, outputs, None)
        return materialise(done, "fold") if order.chunk else done

    small = _scan(df.join(big.select(*order.keys), list(order.keys), "left_anti"), base, inputs, step, outputs, None)
    hot = position(df.join(big.select(*order.keys), list(order.keys), "left_semi"), order, "_pos")
    hot = hot.withColumn("_block", F.floor((F.col("_pos") - 1) / max_rows).cast("long"))
    hot = materialise(hot, "fold-rows")
    blocks = Order(order.keys, ("_pos",), "_block")
    bkeys = list(blocks.part)
    probe = T.StructType([T.StructField("_state", T.StringType())])

    def exits(rows: DataFrame, entry: str | None) -> DataFrame:
        run = _scan(rows, blocks, inputs, lambda s, *v: (step(s, *v)[0], ()), probe, entry)
        return run.groupBy(*bkeys).agg(F.max_by("_state", "_pos").alias("_exit"))

    needed = list(dict.fromkeys([*bkeys, "_pos", *inputs]))
    after = Window.partitionBy(*order.keys).orderBy("_block")
    table = exits(hot.select(*needed), None).withColumn("_entry", F.lit(None).cast("string"))
    table = materialise(table, "fold-state")
    while True:
        moved = table.withColumn("_next", F.lag("_exit").over(after))
        stale = moved.where(~F.col("_next").eqNullSafe(F.col("_entry"))).select(*bkeys, F.col("_next").alias("_entry"))
        stale = materialise(stale, "fold-stale")
        if stale.isEmpty():
            break
        redo = exits(hot.select(*needed).join(stale, bkeys), "_entry").join(stale, bkeys)
        fixed = table.join(stale, bkeys, "left_anti").unionByName(redo)
        table = materialise(fixed, "fold-state")
    done = _scan(hot.join(table.select(*bkeys, "_entry"), bkeys), blocks, inputs, step, outputs, "_entry")
    done = done.drop("_pos", "_block", "_entry")
    out = small.select(*small.columns).unionByName(done.select(*small.columns))
    return materialise(out, "fold") if order.chunk else out
