"""Exact Lloyd clustering of integer vectors with heap-ordered bounds.

Vectors become integers (``floor(scale * x)``), so distances, sums and centroids (componentwise floors of means) are exact
and runs repeat bit by bit.  Every vector holds one number, its gap: how much nearer its centroid was than any other when it
was last scanned.  When centroids move, a cluster's gaps can shrink by at most its own drift plus the largest drift of another
centroid; the sum of these is the cluster's offset.  Gaps are stored plus the offset at the time, in one heap per cluster: as
long as the top of the heap lies above the offset now, no vector of the cluster can have changed sides.  Only vectors whose
gap has expired are popped, scanned exactly against all centroids (ties: the smaller number) and pushed again.  A float margin makes
a gap expire early rather than late.

On Spark: vectors are packed into blocks of a bounded number of rows, in the order the scan yields them (no shuffle; results do not
depend on who shares a block).  A block holds ids, vectors in the narrowest integer type, and its heaps; a round maps blocks to blocks and is
written to the shared folder.  Blocks carry their sums per cluster, which Spark adds up; the driver sees k x (dimensions + 1) sums and
k centroids, never rows.  The first assignment scans all vectors.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones take no part; rows that
repeat an id and a vector are vectors of their own, except that an id starts at most one centroid (its smallest vector); rows without id
are clustered but start no centroid; fewer ids than k give fewer clusters, none at all give no rows; equal distances go to
the smaller number; a centroid that loses all vectors stays where it is.  Other columns are ignored.  Squared distances, summed over all
rows, must fit a 64-bit integer; beyond that the job fails rather than give a wrong number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

BLOCK = "ids binary, kind string, vectors binary, heaps binary, n int, scanned int, sums array<long>"


def kept_vectors(rows: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors of the k ids with the smallest hash, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    one = rows.where("vec_id is not null").select("vec_id", mark.alias("mark"), "v")
    least = one.select("vec_id", "mark").distinct().orderBy("mark").limit(k)  # at most k rows
    some = one.join(F.broadcast(least.select("vec_id")), "vec_id").groupBy("vec_id", "mark").agg(F.min("v").alias("v"))
    return [list(r["v"]) for r in some.orderBy("mark").collect()]


def distances(vectors, centroids):
    """Exact squared distances, a row per vector; integers of 64 bits, or of any size where those might not do."""
    import numpy as np

    far = largest(vectors) + max((abs(x) for c in centroids for x in c), default=0)
    kind = "i8" if far**2 * max(1, vectors.shape[1]) < 2**62 else object
    rows = vectors.astype(kind)
    return np.stack([((rows - np.array(c, kind)) ** 2).sum(axis=1) for c in centroids], axis=1)


def largest(vectors) -> int:
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


def gaps(found):
    """Per row the nearest centroid and by how much it is nearer than the next (as real distances, rounded down)."""
    import numpy as np

    nearest = np.argmin(found, axis=1)  # the first of equal ones
    root = np.sqrt(found.astype("f8"))
    low = np.partition(root, 1, axis=1)[:, 1] if root.shape[1] > 1 else np.full(len(root), np.inf)
    return nearest, (low - root[np.arange(len(root)), nearest]) - margin(low)


def margin(size):
    """More than rounding can lose on square roots of this size and their differences."""
    import numpy as np

    return np.where(np.isfinite(size), size, 0) * 1e-12 + 1e-9


def drifts(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """How far, at most, a gap of each cluster has shrunk: its centroid's move and the longest move of another."""
    import math

    moved = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(old, new, strict=True)]
    moved = [m * (1 + 1e-12) + (1e-9 if m else 0.0) for m in moved]
    return [m + max((o for j, o in enumerate(moved) if j != i), default=0.0) for i, m in enumerate(moved)]


def rescan(heaps: list, vectors, centroids, offsets) -> int:
    """Pop what has expired, scan it against all centroids, push it where it now belongs; returns how many were scanned."""
    import heapq

    popped: list[int] = []
    for heap, offset in zip(heaps, offsets, strict=True):
        while heap and heap[0][0] <= offset:
            popped.append(heapq.heappop(heap)[1])
    if popped:
        nearest, gap = gaps(distances(vectors[popped], centroids))
        for row, cluster, free in zip(popped, nearest.tolist(), gap.tolist(), strict=True):
            heapq.heappush(heaps[cluster], (free + offsets[cluster], row))
    return len(popped)


def sums_of(heaps: list, vectors) -> list[int]:
    """Per cluster the sum of every component, then the number of rows."""
    out: list[int] = []
    for heap in heaps:
        part = vectors[[row for _, row in heap]]
        wide = part.astype("i8" if part.dtype.itemsize < 8 else object)
        total = wide.sum(axis=0) if len(part) else [0] * vectors.shape[1]
        out += [int(x) for x in total] + [len(part)]
    return out


def _narrow(v):
    return v.astype(next(t for t, most in (("i1", 127), ("i2", 2**15 - 1), ("i4", 2**31 - 1), ("i8", 2**63)) if largest(v) <= most))


def _written(ids: bytes, vectors, heaps: list, scanned: int):
    import pickle

    import numpy as np

    flat = [(np.array([g for g, _ in h], "f8"), np.array([r for _, r in h], "i4")) for h in heaps]
    return (ids, vectors.dtype.str, vectors.tobytes(), pickle.dumps(flat), len(vectors), scanned, sums_of(heaps, vectors))


def _read(row: dict, dims: int):
    import pickle

    import numpy as np

    vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, dims)
    return vectors, [list(zip(g.tolist(), r.tolist(), strict=True)) for g, r in pickle.loads(row["heaps"])]


def _batch(rows: list):
    import pyarrow as pa

    kinds = [("ids", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary()), ("heaps", pa.binary()), ("n", pa.int32()), ("scanned", pa.int32()), ("sums", pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def packed(rows: DataFrame, centroids: list[list[int]], dims: int, block_rows: int) -> DataFrame:
    """Blocks after the first assignment, with all offsets at zero."""

    def pack(batches):
        import pickle

        import numpy as np

        ids, parts, held = [], [], 0

        def block():
            vectors = _narrow(np.concatenate(parts))
            heaps = [[] for _ in centroids]
            nearest, gap = gaps(distances(vectors, centroids))
            for row, cluster in enumerate(nearest.tolist()):
                heaps[cluster].append((float(gap[row]), row))
            for heap in heaps:
                heap.sort()  # a sorted list is a heap
            return _batch([_written(pickle.dumps(ids), vectors, heaps, len(vectors))])

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                ids += part.column(0).to_pylist()
                parts.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                held += part.num_rows
                if held >= block_rows:
                    yield block()
                    ids, parts, held = [], [], 0
        if held:
            yield block()

    return rows.select("vec_id", "v").mapInArrow(pack, BLOCK)


def moved(blocks: DataFrame, centroids: list[list[int]], offsets: list[float], dims: int) -> DataFrame:
    """Blocks after the next assignment."""

    def step(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vectors, heaps = _read(row, dims)
                scanned = rescan(heaps, vectors, centroids, offsets)
                yield _batch([_written(row["ids"], vectors, heaps, scanned)])

    return blocks.select("ids", "kind", "vectors", "heaps").mapInArrow(step, BLOCK)


def next_centroids(blocks: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Componentwise floor of the mean; a cluster without rows keeps its centroid.  Reads k x (dims + 1) sums."""
    wide = blocks.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    total = {r["at"]: int(r["x"]) for r in wide.collect()}
    out = []
    for i, old in enumerate(centroids):
        first = i * (dims + 1)
        n = total.get(first + dims, 0)
        out.append([total[first + j] // n for j in range(dims)] if n else old)
    return out


def assignments(blocks: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    def unpack(batches):
        import pickle

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                vectors, heaps = _read(row, dims)
                cluster, away = np.zeros(len(vectors), "i4"), np.zeros(len(vectors), "i8")
                for i, heap in enumerate(heaps):
                    mine = [r for _, r in heap]
                    if mine:
                        cluster[mine], away[mine] = i, distances(vectors[mine], [centroids[i]])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(pickle.loads(row["ids"]), pa.int64()), pa.array(cluster), pa.array(away)], names=["vec_id", "cluster", "distance"])

    return blocks.select("ids", "kind", "vectors", "heaps").mapInArrow(unpack, "vec_id long, cluster int, distance long")


def heap_kmeans(
    rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: float = 64.0, seed: str = "1",
    block_rows: int = 8192,
) -> tuple[DataFrame, list[list[int]], DataFrame]:
    """``vec_id, cluster, distance``; the final centroids; and, per round, how many vectors were scanned.

    ``rounds`` times, all vectors are assigned and the centroids replaced; then vectors are assigned once more.
    """
    spark = rows.sparkSession
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = kept_vectors(rows, id_col, vec_col, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return kept.limit(0).selectExpr("vec_id", "cast(0 as int) as cluster", "0L as distance"), [], spark.createDataFrame([], "round int, scanned long")
    before = conf.get(key, None)
    blocks = materialise(packed(kept, centroids, dims, block_rows), "clusters")
    conf.set(key, "4")  # a block is a row of up to block_rows vectors
    try:
        offsets = [0.0] * len(centroids)
        log = blocks.agg(F.lit(0).alias("round"), F.sum("scanned").cast("long").alias("scanned"))
        for turn in range(rounds):
            fresh = next_centroids(blocks, centroids, dims)
            offsets = [o + d for o, d in zip(offsets, drifts(centroids, fresh), strict=True)]
            centroids = fresh
            blocks = materialise(moved(blocks, centroids, offsets, dims), "clusters")
            log = log.unionByName(blocks.agg(F.lit(turn + 1).alias("round"), F.sum("scanned").cast("long").alias("scanned")))
        out = materialise(assignments(blocks, centroids, dims), "assigned")
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)
    return out, centroids, log


def cluster_report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Every row with its cluster's and the whole inertia and the hash of its centroid; sums of k rows travel, no more."""
    import hashlib

    spark = assigned.sparkSession
    named = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(sums.values())
    if whole >= 2**63:
        raise OverflowError("the inertia does not fit 64 bits")
    table = [(i, int(sums.get(i, 0)), int(whole), digest) for i, digest in named]
    per = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
