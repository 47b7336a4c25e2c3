"""Monotone alignment of two ordered text lists per stream, and retiming from it.

The score table of a stream is cut into tiles of ``tile`` x ``tile`` cells.  Tiles on one diagonal do not depend on each other, so a
diagonal is one Spark job over all streams, and a stream with very long lists is as many tasks as a diagonal has tiles.  Only the last
row and column of a tile are kept; the next diagonal joins them.  The way back recomputes just the tiles that the path crosses.  So
memory is one tile, what is stored grows with the number of rows times the number of tiles along a side, and no cell is left out: there is no band.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.operators.ordered import Order, chunked, position
from tidemark.operators.sequences import interpolate_starts
from tidemark.session import materialise

# fixed values: cost of leaving a left or right row unmatched, and the score of a match
SKIP_LEFT, SKIP_RIGHT, GAIN, PRICE = 0.45, 0.25, 2.4, 1.0
UP, BACK, MATCH = 1, 2, 3


def similarities(left: list[str], right: list[str], kind: str):
    """A matrix of text similarities, left rows by right columns."""
    import numpy as np

    out = np.zeros((len(left), len(right)))
    if kind == "bigram":
        def pairs(t: str) -> set:
            return {t[i:i + 2] for i in range(len(t) - 1)} or {t}

        sets = [pairs(t) for t in right]
        sizes, places = np.array([len(s) for s in sets], "f8"), {}
        for j, s in enumerate(sets):
            for g in s:
                places.setdefault(g, []).append(j)
        places = {g: np.array(js) for g, js in places.items()}
        for i, t in enumerate(left):
            mine = pairs(t)
            for g in mine:
                if g in places:
                    out[i, places[g]] += 1
            out[i] /= len(mine) + sizes - out[i]
        return out
    from difflib import SequenceMatcher

    matcher, seen = SequenceMatcher(None, "", "", autojunk=False), {}
    for j, b in enumerate(right):
        if b in seen:
            out[:, j] = out[:, seen[b]]
            continue
        seen[b] = j
        matcher.set_seq2(b)
        known: dict[str, float] = {}
        for i, a in enumerate(left):
            if a not in known:
                matcher.set_seq1(a)
                known[a] = matcher.ratio()
            out[i, j] = known[a]
    return out


def fill_tile(top, side, similar):
    """Scores of a tile from its upper and left edge (both with the corner), and the choice in every cell; the first option wins ties."""
    import numpy as np

    h, w = similar.shape
    score, choice = np.empty((h + 1, w + 1)), np.zeros((h + 1, w + 1), "i1")
    score[0, :], score[:, 0] = top, side
    for total in range(2, h + w + 1):
        i = np.arange(max(1, total - w), min(h, total - 1) + 1)
        j = total - i
        up, back = score[i - 1, j] - SKIP_LEFT, score[i, j - 1] - SKIP_RIGHT
        match = score[i - 1, j - 1] + GAIN * similar[i - 1, j - 1] - PRICE
        best = np.where((up >= back) & (up >= match), UP, np.where(back >= match, BACK, MATCH))
        choice[i, j] = best
        score[i, j] = np.choose(best - 1, (up, back, match))
    return score, choice


def border(start: float, step: float, n: int):
    """``start`` and n more values, each ``step`` below the one before."""
    import numpy as np

    return np.subtract.accumulate(np.concatenate(([start], np.full(n, step))))


def walk_back(choice, i: int, j: int) -> tuple[list[tuple[int, int]], int, int]:
    """Matched cells from (i, j) to the tile's edge, and where the edge is met."""
    met = []
    while i and j:
        step = choice[i, j]
        if step == MATCH:
            met.append((i, j))
        i, j = i - (step != BACK), j - (step != UP)
    return met, i, j


def _blocks(df: DataFrame, keys: tuple[str, ...], tile: int, side: str) -> DataFrame:
    """Rows of one side in blocks of ``tile`` texts, in order."""
    rows, order = chunked(df.select(*keys, "seq", tx.word_key(F.col("text")).alias("key")), Order(keys, ("seq",)), tile * 64)
    rows = position(rows, order, "pos").withColumn(side, F.floor((F.col("pos") - 1) / tile))
    held = F.array_sort(F.collect_list(F.struct("pos", "seq", "key")))  # at most ``tile`` rows
    return rows.groupBy(*keys, side).agg(held.alias("h")).select(*keys, side, F.col("h.seq").alias(f"{side}_seq"), F.col("h.key").alias(f"{side}_key"))


def align_sequences(
    left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("stream_id",), similar: str = "sequence", tile: int = 1024,
) -> DataFrame:
    """JOIN20: matched (left, right) rows of the best monotone alignment; the first option wins ties."""
    spark, names = left.sparkSession, list(keys)
    a, b = materialise(_blocks(left, keys, tile, "lb"), "align-left"), materialise(_blocks(right, keys, tile, "rb"), "align-right")
    ends = a.groupBy(*keys).agg(F.max("lb").alias("last_lb")).join(b.groupBy(*keys).agg(F.max("rb").alias("last_rb")), names)
    ends = materialise(ends, "align-ends")
    far = ends.agg(F.max(F.col("last_lb") + F.col("last_rb"))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers, near = T.ArrayType(T.DoubleType()), T.StructType().add("seq", "long").add("match_seq", "long").add("similarity", "double")
    made = T.StructType([left.schema[k] for k in names]).add("lb", "long").add("rb", "long").add("bottom", numbers).add("side", numbers)
    made = made.add("pairs", T.ArrayType(near)).add("to_lb", "long").add("to_rb", "long").add("at_i", "integer").add("at_j", "integer")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(made)
        for batch in batches:
            for row in batch.to_pylist():
                like = similarities(row["lb_key"], row["rb_key"], similar)
                h, w = like.shape
                top, side = row["top"], row["left"]
                start = top[0] if top else side[0] if side else 0.0
                top = np.array(top) if top else border(start, SKIP_RIGHT, w)
                side = np.array(side) if side else border(start, SKIP_LEFT, h)
                score, choice = fill_tile(top, side, like)
                out = {k: row[k] for k in (*names, "lb", "rb")} | dict.fromkeys(("bottom", "side", "pairs", "to_lb", "to_rb", "at_i", "at_j"))
                if not row["seen"]:
                    out |= {"bottom": score[-1].tolist(), "side": score[:, -1].tolist()}
                if row["at_i"] is not None or row["last"]:
                    met, i, j = walk_back(choice, *((h, w) if row["last"] else (row["at_i"], row["at_j"])))
                    out["pairs"] = [{"seq": row["lb_seq"][x - 1], "match_seq": row["rb_seq"][y - 1], "similarity": float(like[x - 1, y - 1])} for x, y in met]
                    # a tile before is whole, so an edge that was met is its last row or column
                    lb, rb = row["lb"] - (not i), row["rb"] - (not j)
                    if lb >= 0 and rb >= 0:
                        out |= {"to_lb": lb, "to_rb": rb, "at_i": i or tile, "at_j": j or tile}
                yield pa.RecordBatch.from_pylist([out], schema)

    def tiles(which: DataFrame, before: DataFrame | None) -> DataFrame:
        """Texts and edges of the named tiles."""
        rows = which.join(a, [*names, "lb"]).join(b, [*names, "rb"])
        if before is None:
            rows = rows.withColumns({"top": F.lit(None).cast("array<double>"), "left": F.lit(None).cast("array<double>")})
        else:
            over = before.select(*names, (F.col("lb") + 1).alias("lb"), "rb", F.col("bottom").alias("top"))
            beside = before.select(*names, "lb", (F.col("rb") + 1).alias("rb"), F.col("side").alias("left"))
            rows = rows.join(over, [*names, "lb", "rb"], "left").join(beside, [*names, "lb", "rb"], "left")
        return rows.repartition(parts, *names, "lb", "rb").mapInArrow(run, made)

    none = F.lit(None).cast("int")
    found: list[DataFrame] = []
    for d in range((far if far is not None else -1) + 1):
        spots = F.sequence(F.greatest(F.lit(0), d - F.col("last_rb")), F.least(F.lit(d), F.col("last_lb")))
        which = ends.where(F.col("last_lb") + F.col("last_rb") >= d).withColumn("lb", F.explode(spots)).withColumn("rb", d - F.col("lb"))
        last = (F.col("lb") == F.col("last_lb")) & (F.col("rb") == F.col("last_rb"))
        which = which.select(*names, "lb", "rb", none.alias("at_i"), none.alias("at_j"), last.alias("last"), F.lit(False).alias("seen"))
        found.append(materialise(tiles(which, found[d - 1] if d else None), f"align-{d}"))
    # back along the paths, a diagonal at a time
    paths = list(found)
    for d in range(len(found) - 2, -1, -1):
        sources = [t.select(*names, F.col("to_lb").alias("lb"), F.col("to_rb").alias("rb"), "at_i", "at_j") for t in (*paths[d + 1:d + 3], *found[d + 1:d + 3])]
        which = reduce(DataFrame.unionByName, sources).where(F.col("lb") + F.col("rb") == d).distinct()
        which = which.withColumns({"last": F.lit(False), "seen": F.lit(True)})
        paths[d] = materialise(tiles(which, found[d - 1] if d else None), f"align-path-{d}")
    all_pairs = [t.where("pairs is not null").select(*names, F.explode("pairs").alias("p")) for t in {id(t): t for t in (*found, *paths)}.values()]
    if not all_pairs:
        return spark.createDataFrame([], T.StructType([*[left.schema[k] for k in names], *near.fields]))
    return reduce(DataFrame.unionByName, all_pairs).select(*names, "p.seq", "p.match_seq", "p.similarity")


def retime(
    left: DataFrame, right: DataFrame, order: Order, lower: Column, upper: Column, at_least: float = 0.5, similar: str = "sequence",
) -> DataFrame:
    """Starts for left rows from matched right rows, interpolated between them (JOIN20 then WIN17)."""
    keys = list(order.keys)
    pairs = align_sequences(left, right, order.keys, similar).where(F.col("similarity") >= at_least)
    anchors = pairs.join(right.select(*keys, F.col("seq").alias("match_seq"), F.col("start_ms").alias("anchor")), [*keys, "match_seq"])
    # read by several running values below, and costly to make: written once
    anchors = materialise(anchors.select(*keys, "seq", "anchor"), "anchors")
    rows = left.join(anchors, [*keys, "seq"], "left")
    return interpolate_starts(rows, order, "anchor", lower, upper)
