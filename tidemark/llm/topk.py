"""Exact inner-product top-k by ball trees, one per shard, with branch and bound.

Vectors become integers (``floor(scale * x)``), so scores are exact.  Rows are dealt to shards of a bounded size; each
shard's ball tree is one row of bytes.  Queries travel in blocks of a bounded size.  Every block first searches one shard;
the k-th score found there is handed to its searches of all other shards and rises while they run.  A node is left out only if
its upper bound, query . centre + |query| * radius, is below the query's current k-th score.

Defined cases: null vectors, vectors with null or non-finite components and rows without id take no part; rows that repeat
both id and vector count once; several vectors under one id are all candidates for others and queries of their own; vectors
of different length are compared as if the shorter ended in zeros; ties go to the smaller id; an empty table gives no rows; other
columns are ignored.  Scores must fit a 64-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise

FOUND = "query_id long, q_no long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def build_tree(ids, rows, leaf: int) -> dict:
    """A ball tree in arrays: rows in node order, and per node its range, children, centre and radius."""
    import numpy as np

    order = np.lexsort((np.arange(len(ids)), ids))
    ids, rows = ids[order], rows[order].astype("f8")
    nodes, place = [], np.arange(len(ids))

    def split(lo: int, hi: int) -> int:
        at, part = len(nodes), rows[place[lo:hi]]
        centre = part.mean(axis=0)
        far = ((part - centre) ** 2).sum(axis=1)
        nodes.append([lo, hi, -1, -1, centre, float(np.sqrt(far.max()))])
        if hi - lo > leaf and far.max() > 0:
            a = part[far.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            side = part @ (b - a)
            turn = np.argsort(side, kind="stable")
            place[lo:hi] = place[lo:hi][turn]
            mid = (lo + hi) // 2
            nodes[at][2], nodes[at][3] = split(lo, mid), split(mid, hi)
        else:
            place[lo:hi] = np.sort(place[lo:hi])  # ids rise within a leaf
        return at

    split(0, len(ids))
    return {
        "ids": ids[place], "rows": rows[place], "lo": [n[0] for n in nodes], "hi": [n[1] for n in nodes], "left": [n[2] for n in nodes], "right": [n[3] for n in nodes],
        "centre": np.array([n[4] for n in nodes]), "radius": np.array([n[5] for n in nodes]),
    }


def search_tree(tree: dict, q_ids, queries, best_scores, best_ids, floor) -> None:
    """Improve ``best_scores`` and ``best_ids`` (a row of k per query) in place; ``floor`` is the k-th score known elsewhere."""
    import numpy as np

    k = best_scores.shape[1]
    d = max(queries.shape[1], tree["rows"].shape[1])
    wide = lambda m: m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1])))
    rows, centre, queries = wide(tree["rows"]), wide(tree["centre"]), wide(queries)
    norm = np.sqrt((queries**2).sum(axis=1))
    largest = norm.max(initial=0) * (np.sqrt((rows**2).sum(axis=1)).max(initial=0))
    exact = largest < 2**52  # beyond that, products are taken with whole numbers of any size
    slack = 1e-9 * largest + 1e-6

    def bound(node, some):
        return queries[some] @ centre[node] + norm[some] * tree["radius"][node] + slack

    def visit(node: int, some) -> None:
        some = some[bound(node, some) >= np.maximum(best_scores[some, -1].astype("f8"), floor[some])]
        if not len(some):
            return
        left, right = tree["left"][node], tree["right"][node]
        if left >= 0:
            first = bound(left, some) >= bound(right, some)
            for part, one, two in ((some[first], left, right), (some[~first], right, left)):
                if len(part):
                    visit(one, part)
                    visit(two, part)
            return
        lo, hi = tree["lo"][node], tree["hi"][node]
        ids = tree["ids"][lo:hi]
        if exact:
            scores = np.rint(queries[some] @ rows[lo:hi].T).astype("i8")
        else:
            scores = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in rows[lo:hi]] for x in queries[some]], "i8")
        scores = np.where(ids[None, :] == q_ids[some][:, None], LEAST, scores)
        hit = scores.max(axis=1) >= best_scores[some, -1]
        some, scores = some[hit], scores[hit]
        if len(some):
            s = np.concatenate([best_scores[some], scores], axis=1)
            i = np.concatenate([best_ids[some], np.broadcast_to(ids, scores.shape)], axis=1)
            top = np.lexsort((i, -s), axis=-1)[:, :k]
            best_scores[some], best_ids[some] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)

    visit(0, np.arange(len(q_ids)))


#: stands for "none yet"; no score of real vectors is this low
LEAST = -(2**63) + 1


def exact_top_k(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: float = 256.0,
    shard_rows: int = 2048, block_rows: int = 1024, leaf: int = 64,
) -> DataFrame:
    """For every row that ``is_query`` (a condition on ``vec_id``) marks: its k best other rows, ranked from 1."""
    rows = materialise(integer_vectors(vectors, id_col, vec_col, scale), "topk-rows")
    n, n_queries = (rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()[i] for i in (0, 1))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))

    def packed(df: DataFrame, parts: int, as_tree: bool, label: str) -> DataFrame:
        def pack(table):
            import pickle

            import numpy as np
            import pyarrow as pa

            group, lists = table.column("part")[0].as_py(), table.column("v").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            whole = np.zeros((len(sizes), int(sizes.max())), "f8")
            whole[np.arange(whole.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
            ids = table.column("vec_id").to_numpy()
            order = np.lexsort((*whole.T[::-1], ids))
            ids, whole = ids[order], whole[order]
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | (whole[1:] != whole[:-1]).any(axis=1)
            ids, whole = ids[fresh], whole[fresh]
            value = build_tree(ids, whole, leaf) if as_tree else {"ids": ids, "rows": whole}
            return pa.table({"part": pa.array([group], pa.int64()), "blob": pa.array([pickle.dumps(value)], pa.binary())})

        part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("long")
        return materialise(df.withColumn("part", part).groupBy("part").applyInArrow(pack, "part long, blob binary"), label)

    trees = packed(rows, shards, True, "topk-trees").withColumnsRenamed({"part": "shard", "blob": "tree"})
    asked = packed(rows.where(is_query), blocks, False, "topk-queries").withColumnsRenamed({"part": "block", "blob": "asked"})

    def search(batches):
        import pickle

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                t, q = pickle.loads(row["tree"]), pickle.loads(row["asked"])
                m = len(q["ids"])
                scores, ids = np.full((m, k), LEAST, "i8"), np.full((m, k), 2**63 - 1, "i8")
                least = np.full(m, -np.inf)
                if row.get("floors") is not None:
                    no, value = np.array([x["q_no"] for x in row["floors"]], "i8"), [x["floor"] for x in row["floors"]]
                    least[no] = value
                search_tree(t, q["ids"], q["rows"], scores, ids, least)
                hit = scores > LEAST
                q_no = np.broadcast_to(np.arange(m)[:, None], hit.shape)[hit]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q["ids"][q_no], q_no, ids[hit], scores[hit], np.full(len(q_no), row["block"]))], names=["query_id", "q_no", "vec_id", "score", "block"])

    schema = f"{FOUND}, block long"
    home = F.pmod(F.col("block"), F.lit(shards))
    pairs = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    ours = pairs.where(F.col("shard") == home).join(asked, "block")
    first = materialise(ours.repartition("block", "shard").mapInArrow(search, schema), "topk-first")
    # the k-th score of every query's first shard; only full lists bound anything
    floors = first.groupBy("block", "q_no").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    floors = floors.groupBy("block").agg(F.collect_list(F.struct("q_no", "floor")).alias("floors"))  # at most block_rows entries
    others = pairs.where(F.col("shard") != home).join(asked.join(floors, "block", "left"), "block")
    found = first.unionByName(others.repartition("block", "shard").mapInArrow(search, schema))
    best = Window.partitionBy("block", "q_no").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
