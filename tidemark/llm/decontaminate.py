"""Benchmark decontamination: SimHash windows as long as an item, multi-index Hamming blocks, exact weighted similarity.

Words are lower-cased and freed of signs at their ends; shingles are five words.  Every benchmark item has a 64-bit SimHash of its
weighted shingles (rarer among items: heavier).  Windows of a document have the item's number of words, at every
offset; the index cuts fingerprints into blocks and lists each block's neighbours, so that by the pigeonhole principle all
items within ``radius`` bits are found.  Candidates count if the weighted Jaccard similarity of shingles, with their
numbers, is at least ``least``.

A window that shares no shingle with an item has similarity 0, so fingerprints are taken only where a window holds a shingle of
an item of its length.  That leaves out no hit.

How many items hold a shingle, and how many items there are, is counted once over the whole benchmark.  Documents are first
marked with the counts of the benchmark shingles that they hold, by passes over bounded parts of the counts; the others go.
Then the items travel to the tasks in slices of at most ``slice_bytes`` of text, one pass over the marked documents for each.
Weights come from the counts and marks alone, so the number of slices changes no row; the usual benchmark is one slice.

Defined cases: null and empty texts hit nothing; null and empty items are ignored; an item of fewer than five words is one
shingle and hits where its words stand in a row; items with equal text are all reported; of several windows of a
document on an item the best counts, then the first; rows that repeat an id are looked at one by one; other columns are
ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, materialise, worker_table
from tidemark.llm.jaccard_join import mix, only

HIT = "doc_id long, item_id long, first_word long, n_words long, similarity double"
ENDS = b".,;:!?\"'()[]{}<>|*_-"


class BareHashes(dict):
    """Hashes of words without signs at their ends (0 for nothing but signs), by the word as it stands."""

    most = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        bare = word.decode("utf-8", "replace").lower().encode().strip(ENDS)
        self[word] = h = (xxhash.xxh3_64_intdigest(bare) or 1) if bare else 0
        return h


def bare_hashes() -> BareHashes:
    """The table of this worker process."""
    return worker_table("bare words", BareHashes)


def windows_of(w, width: int):
    """Hashes of the ``width``-word shingles that begin at each word."""
    import numpy as np

    m = len(w) - width + 1
    if m <= 0:
        return np.zeros(0, "u8")
    h = np.full(m, width, "u8")
    for i in range(width):
        h = mix(h, 3) + w[i : i + m]
    return mix(h, 5)


def signs(h):
    """The bits of each hash as -1 and 1."""
    import numpy as np

    return np.unpackbits(h.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4") * 2 - 1


def packed(sums):
    import numpy as np

    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


@dataclasses.dataclass
class ItemIndex:
    """Items of one slice of the benchmark, ready to be searched."""

    ids: list[int]
    lengths: list[int]  # in words
    shingles: list[dict[int, int]]
    weights: dict[int, float]
    total: int  # items of the whole benchmark
    width: int
    radius: int
    blocks: int

    def __post_init__(self):
        import itertools

        import numpy as np

        prints = []
        for own in self.shingles:
            h = np.fromiter(own, "u8", len(own))
            n = np.array([own[x] * self.weights[x] for x in own], "f4")
            prints.append(packed((signs(h) * n[:, None]).sum(axis=0, keepdims=True))[0])
        self.prints = np.array(prints, "u8")
        self.cuts = np.linspace(0, 64, self.blocks + 1).astype(int)
        near = self.radius // self.blocks
        keys, items = [], []
        for b in range(self.blocks):
            bits = int(self.cuts[b + 1] - self.cuts[b])
            flips = np.array([sum(1 << i for i in c) for k in range(near + 1) for c in itertools.combinations(range(bits), k)], "u8")
            value = self.block(self.prints, b)
            keys.append((self.key(np.array(self.lengths, "u8"), b)[:, None] + (value[:, None] ^ flips[None, :])).reshape(-1))
            items.append(np.repeat(np.arange(len(self.ids)), len(flips)))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        # which items hold a shingle, and a small table that most other shingles miss
        pairs = sorted((x, i) for i, own in enumerate(self.shingles) for x in own)
        self.held = np.array([x for x, _ in pairs], "u8")
        self.holder = np.array([i for _, i in pairs], "i8")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.held >> np.uint64(44)).astype("i8")] = True
        self.short = sorted({n for n in self.lengths if n < self.width})

    def block(self, prints, b: int):
        import numpy as np

        lo, hi = int(self.cuts[b]), int(self.cuts[b + 1])
        return (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def key(self, lengths, b: int):
        import numpy as np

        return (lengths * np.uint64(self.blocks) + np.uint64(b)) << np.uint64(32)

    def near(self, prints, length: int):
        """(window, item) for all items of ``length`` words within the radius of a window's fingerprint."""
        import numpy as np

        found = []
        for b in range(self.blocks):
            key = self.key(np.uint64(length), b) + self.block(prints, b)
            lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.stack([window, self.items[at]]))
        pair = np.unique(np.concatenate(found, axis=1), axis=1)
        apart = np.bitwise_count(prints[pair[0]] ^ self.prints[pair[1]])
        return pair[:, apart <= self.radius]

    def similarity(self, shingles, item: int, weigh: dict[int, float]) -> float:
        from collections import Counter

        there, own, get = Counter(shingles.tolist()), self.shingles[item], self.weights.get
        both = sum(min(n, there[x]) * get(x) for x, n in own.items())
        one = sum(n * get(x) for x, n in own.items()) + sum(n * weigh[x] for x, n in there.items())
        return both / (one - both) if one > both else 1.0

    def holders(self, h):
        """(place, item) for all places of ``h`` whose shingle an item holds."""
        import numpy as np

        place = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype("i8")])
        lo, hi = np.searchsorted(self.held, h[place]), np.searchsorted(self.held, h[place], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(place, n), self.holder[at]

    def search(self, w, place, item, least: float, marks):
        """Best windows per item in the words ``w``; ``place`` and ``item`` say where items' shingles stand.

        ``marks`` holds, for each shingle of ``w`` that any item of the benchmark holds, its place and how many items do.
        """
        import numpy as np

        best: dict[int, tuple[float, int, int]] = {}
        lengths = np.array(self.lengths)[item]
        h = windows_of(w, self.width)
        held = np.zeros(len(h), "i8")
        held[marks[:, 0]] = marks[:, 1]
        counts, at = np.unique(held, return_inverse=True)
        exact = np.array([weight_of(n, self.total) for n in counts.tolist()], "f8")[at]
        weigh, weight = dict(zip(h.tolist(), exact.tolist(), strict=True)), exact.astype("f4")
        sums = np.concatenate([np.zeros((1, 64), "f8"), np.cumsum(signs(h) * weight[:, None], axis=0, dtype="f8")])
        for length in np.unique(lengths).tolist():
            span = length - self.width + 1  # shingles in a window
            first = np.unique(place[lengths == length])
            # a text shorter than the item is one window
            starts = np.unique(np.clip(first[:, None] - np.arange(span)[None, :], 0, max(0, len(h) - span)))
            for lot in np.array_split(starts, max(1, len(starts) // 20_000)):
                ends = np.minimum(lot + span, len(h))
                for window, i in self.near(packed(sums[ends] - sums[lot]), length).T.tolist():
                    a, b = int(lot[window]), int(ends[window])
                    s = self.similarity(h[a:b], i, weigh)
                    if s >= least and (i not in best or (-s, a) < (-best[i][0], best[i][1])):
                        best[i] = (s, a, min(length, len(w)))
        return best


def weight_of(holders: int, total: int) -> float:
    """The weight of a shingle that ``holders`` of ``total`` items hold."""
    import math

    return math.log(1 + (total + 1) / (holders + 1))


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """Every item that has a word: ``item_id``, ``slice``, ``n_words`` and its shingles with their numbers."""
    schema = "item_id long, slice int, n_words long, shingles array<long>, numbers array<long>"

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        known = bare_hashes()
        for batch in batches:
            rows = []
            for item_id, text, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.fromiter(map(known.__getitem__, text.encode("utf-8", "surrogatepass").split()), "u8")
                w = w[w != 0]
                if len(w):
                    own = Counter(windows_of(w, min(width, len(w))).view("i8").tolist())
                    rows.append((item_id, k, len(w), list(own), list(own.values())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item_id", "slice", "n_words", "shingles", "numbers"])

    return bounded_batches(items.select("item_id", "text", "slice")).mapInArrow(run, schema)


def build_items(rows: list, holders: dict[int, int], total: int, width: int, radius: int, blocks: int) -> ItemIndex | None:
    """The index of (id, number of words, shingles, their numbers) rows; ``holders`` counts the benchmark's items by shingle."""
    rows = sorted(rows)
    whole = (1 << 64) - 1
    shingles = [{x & whole: n for x, n in zip(r[2], r[3], strict=True)} for r in rows]
    weights = {x & whole: weight_of(n, total) for x, n in holders.items()}
    return ItemIndex([r[0] for r in rows], [r[1] for r in rows], shingles, weights, total, width, radius, blocks) if rows else None


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 5, least: float = 0.8, radius: int = 23, blocks: int = 6, slice_bytes: int = 1 << 18, part_rows: int = 1 << 21, id_type: str = "long",
) -> DataFrame:
    """A row for each document and item it holds: where, over how many words, how similar."""
    rows = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-int(size) // slice_bytes))
    made = materialise(item_shingles(items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)).cast("int")), width), "benchmark-items")
    holders = materialise(made.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")), "benchmark-shingles")
    total = made.count()
    short = sorted(r[0] for r in made.where(F.col("n_words") < width).select("n_words").distinct().collect())  # fewer than ``width`` numbers
    parts = max(1, -(-holders.count() // part_rows))
    marked = rows.withColumn("marks", F.lit(None).cast("binary"))
    for k in range(parts):
        own = holders.where(F.pmod(F.xxhash64("shingle"), F.lit(parts)) == k).collect()  # at most about part_rows
        marked = _mark(marked, spark.sparkContext.broadcast(_counted(own)), short, width, last=k == parts - 1)
    if slices > 1:
        marked = materialise(marked, "marked-documents")
    out = None
    for k in range(slices):
        mine = made.where(F.col("slice") == k)
        own = mine.select("item_id", "n_words", "shingles", "numbers").collect()  # at most about slice_bytes of text
        if not own:
            continue
        counts = holders if slices == 1 else holders.join(mine.select(F.explode("shingles").alias("shingle")).distinct(), "shingle", "left_semi")
        index = build_items([tuple(r) for r in own], {r["shingle"]: r["n"] for r in counts.collect()}, total, width, radius, blocks)
        hits = _scan(marked, spark.sparkContext.broadcast(index), least)
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], HIT.replace("long", id_type, 1)) if out is None else out


def _counted(rows: list):
    """Sorted hashes and their counts, and a small table that most other hashes miss."""
    import numpy as np

    held = np.array([r["shingle"] for r in rows], "i8").view("u8")
    n = np.array([r["n"] for r in rows], "i8")
    order = np.argsort(held)
    maybe = np.zeros(1 << 20, bool)
    maybe[(held >> np.uint64(44)).astype("i8")] = True
    return held[order], n[order], maybe


def _mark(rows: DataFrame, shared, short: list[int], width: int, last: bool) -> DataFrame:
    """Adds to ``marks`` the place and count of each shingle of a document that is among ``shared``; null: none so far."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, n, maybe = shared.value
        for batch in batches:
            owner, w, bounds = _words(batch.column(1))
            marks = batch.column(2).to_pylist()
            for size in (*short, width):
                h = windows_of(w, size)
                place = np.flatnonzero(maybe[(h >> np.uint64(44)).astype("i8")])
                at = np.minimum(np.searchsorted(held, h[place]), max(0, len(held) - 1))
                same = held[at] == h[place] if len(held) else np.zeros(0, bool)
                place, at = place[same], at[same]
                keep = owner[place] == owner[place + size - 1]
                place, at = place[keep], at[keep]
                for d in np.unique(owner[place]).tolist():
                    marks[d] = marks[d] or b""
                    if size == width:
                        mine = owner[place] == d
                        marks[d] += np.stack([place[mine] - bounds[d], n[at[mine]]], axis=1).astype("<i8").tobytes()
            made = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(marks, pa.binary())], names=["doc_id", "text", "marks"])
            yield made.filter(pa.array([m is not None for m in marks], pa.bool_())) if last else made

    return bounded_batches(rows).mapInArrow(run, rows.schema)


def _words(column):
    """Of a batch's texts: the row of each word, the words' hashes, and where each row's words begin."""
    import numpy as np

    known = bare_hashes()
    texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in column.to_pylist()]
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    w = np.fromiter((known[x] for t in texts for x in t), "u8", int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)[w != 0]
    return owner, w[w != 0], np.searchsorted(owner, np.arange(len(texts) + 1))


def _scan(rows: DataFrame, shared, least: float) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        index = shared.value
        for batch in batches:
            kinds, got = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64()], []
            owner, w, bounds = _words(batch.column(1))
            marks = batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            for width in (*index.short, index.width):
                h = windows_of(w, width)
                place, item = index.holders(h)
                keep = owner[place] == owner[np.minimum(place + width - 1, len(owner) - 1)]
                place, item = place[keep], item[keep]
                if width < index.width:  # short items stand in a row or not at all
                    for p, i in dict((((int(owner[p]), i), (p, i)) for p, i in sorted(zip(place.tolist(), item.tolist(), strict=True), reverse=True) if index.lengths[i] == width)).values():
                        got.append((ids[owner[p]], index.ids[i], p - int(bounds[owner[p]]), width, 1.0))
                    continue
                long = np.array(index.lengths)[item] >= width
                place, item = place[long], item[long]
                for d in np.unique(owner[place]).tolist():
                    mine = owner[place] == d
                    best = index.search(w[bounds[d] : bounds[d + 1]], place[mine] - bounds[d], item[mine], least, np.frombuffer(marks[d], "<i8").reshape(-1, 2))
                    got += [(ids[d], index.ids[i], a, n, s) for i, (s, a, n) in best.items()]
            columns = list(zip(*got, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HIT.split(", ")])

    return bounded_batches(rows).mapInArrow(run, HIT.replace("long", rows.schema["doc_id"].dataType.simpleString(), 1))


def without_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, that hold no benchmark item.  Each row goes by its own id and text, null or repeated ids too."""
    key = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(key.alias("__key"), F.col(text_col).alias("__text"))
    hit = benchmark_hits(rows, benchmark, id_col="__key", text_col="__text", id_type="string", **options)
    hit = materialise(hit.select(F.col("doc_id").alias("__hit")).distinct(), "benchmark-hits")
    return only(docs.withColumn("__key", key), hit, {"__key": "__hit"}, keep=False, store=False).drop("__key")
