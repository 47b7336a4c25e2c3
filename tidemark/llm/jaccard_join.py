"""Exact Jaccard join of word-shingle sets in metric space, and the groups it links.

Jaccard distance is a metric, and so is the count of differing shingles, which it rises with: two sets of sizes a and b link
if they differ in at most e = (1 - t) / (1 + t) * (a + b) shingles.  The join narrows down regions until they are small, and every
step keeps all links:

1. *Copies.*  Equal sets become one node.
2. *Size pivots.*  Sizes that differ too much can't link, so sizes are cut into bands; a node at a band's lower side is
   replicated to the next band, where larger partners may be.
3. *Slices.*  Documents that share nothing are all equally far from any pivot, so document pivots alone can't part
   them.  The shingle space is cut into more slices than e: two linked sets are then equal in a slice, so the content of a
   slice is a region of radius 0.  Slices of one or no shingle would be crowded regions; they count only together with
   their neighbour slice, less one shingle at most (of two neighbours in some pair, at most one shingle differs).
4. *Document pivots.*  A region's nodes go to their nearest pivot (Voronoi regions).  A node y also goes to the window of another
   pivot p if d(y, p) <= d(y, own pivot) + 2 e, which is all that the triangle inequality leaves.  Regions join recursively.
   Distances there are between count vectors of 256 shingle classes; they never exceed the true ones, so windows lose nothing.
5. *Parities.*  Of every set there is a row of about 2 n bits, each the parity of the shingles that fall on it.  Two rows differ in
   no more bits than their sets in shingles, so this drops most false candidates (long texts, whose class counts all look
   alike) before any set travels.
6. *Exact check.*  What is left is compared shingle by shingle (64-bit hashes).

Only groups are asked for, so not all pairs of a dense region are compared.  First every region offers a spanning forest of its
candidates; then, with the groups these give, all candidates that would still join two groups.

A region with very many nodes is cut into blocks, and pairs of blocks are joined in tasks of their own; which regions are that
large is judged from a sample of nodes, which moves work but never links.

Defined cases: null and empty texts have no shingle and link to nothing; fewer words than a shingle has give one shingle; rows
without id take no part in links (their component is null); rows that repeat an id are looked at one by one, and a link to one of
them is a link to that id; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, materialise, worker_table
from tidemark.llm.components import components

CLASSES = 256
SKETCH = "doc_id long, n int, h1 long, h2 long, counts binary, bits binary"
PLACES = "node long, h1 long, regions array<long>"


@dataclasses.dataclass(frozen=True)
class Rule:
    """Sets of ``width``-word shingles link if their Jaccard similarity is at least ``num / den``."""

    width: int = 3
    num: int = 90
    den: int = 100

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which linked sets of sizes a and b differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def bands(self, largest: int) -> list[int]:
        """Upper ends of the size bands; a partner is in the same band or the next."""
        t = Fraction(self.num, self.den)
        # up to the first end, a set links to equal ones only: n / (n + 1) < t
        ends = [-(-self.num // max(1, self.den - self.num)) - 1]
        while ends[-1] < largest:
            ends.append(max(int(ends[-1] / t), ends[-1] + 1))
        return [*ends, max(int(ends[-1] / t), ends[-1] + 1)]


def mix(h, salt: int = 0):
    """64-bit mixing of an array."""
    import numpy as np

    h = h + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words (bytes), kept within a bound."""

    most = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes() -> WordHashes:
    """The table of this worker process."""
    return worker_table("words", WordHashes)


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int, known: WordHashes):
    """Hashes of the shingles in text order; fewer words than ``width`` make one."""
    import numpy as np

    w = np.fromiter(map(known.__getitem__, words), "u8", len(words))
    if not len(w):
        return w
    m = max(1, len(w) - width + 1)
    h = np.full(m, min(width, len(w)), "u8")
    for i in range(min(width, len(w))):
        h = mix(h, 3) + w[i : i + m]
    return mix(h, 5)


def shingle_set(text: str | None, width: int, known: WordHashes):
    import numpy as np

    return np.unique(shingle_hashes(text_words(text), width, known))


def parities(s) -> bytes:
    """A bit for each of 2 n places or more (a power of two): the parity of the shingles that fall on it."""
    import numpy as np

    m = max(64, 1 << (2 * len(s)).bit_length())
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype("i8"), minlength=m) & 1).astype("u1")).tobytes()


def parity_gap(x: bytes, y: bytes) -> int:
    """The bits in which two rows of parities differ: at most the shingles in which their sets do."""
    import numpy as np

    a, b = sorted((np.frombuffer(x, "u1"), np.frombuffer(y, "u1")), key=len)
    while len(b) > len(a):  # as if made with half as many places
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def region_keys(s, rule: Rule, ends: list[int]):
    """The regions of a set: its slices in its own size band and the next."""
    import numpy as np

    n, out = len(s), []
    own = int(np.searchsorted(ends, n))
    if own == 0:  # so few shingles that only equal sets link
        return np.zeros(0, "u8")
    mixed = mix(s, 7)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(mixed, dtype="u8")])
    for band in (own, own + 1):
        m = rule.differ(ends[band], ends[band]) + 1
        m += m % 2
        cut = np.searchsorted(s, (np.arange(1, m, dtype="f8") * (2.0**64 / m)).astype("u8"))
        cut = np.concatenate([[0], cut, [n]])
        count, content = np.diff(cut), sums[cut[1:]] - sums[cut[:-1]]
        place = mix(np.arange(m, dtype="u8") + np.uint64(band << 40), 11)
        strong = count > 1
        out.append(mix(content[strong] + count[strong].astype("u8") + place[strong], 13))
        weak = np.flatnonzero(~strong)
        if not len(weak):
            continue
        beside = weak ^ 1
        # the neighbour whole, and without each of its shingles
        many = count[beside]
        who = np.repeat(np.arange(len(weak)), many)
        less = mixed[np.arange(len(who)) + np.repeat(cut[beside] - np.cumsum(many) + many, many)]
        kinds = np.concatenate([content[beside], content[beside][who] - less])
        sizes = np.concatenate([many, many[who] - 1]).astype("u8")
        base = content[weak] + count[weak].astype("u8") + place[weak]
        out.append(mix(mix(kinds + sizes, 17) + np.concatenate([base, base[who]]), 19))
    return np.unique(np.concatenate(out))


def sketches(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Per document: size, 128-bit hash of its set and class counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = word_hashes()
        for batch in batches:
            n, h1, h2, counts, bits = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, rule.width, known)
                n.append(len(s))
                h1.append(int(mix(s, 23).sum(dtype="u8").view("i8")))
                h2.append(int(mix(s, 29).sum(dtype="u8").view("i8")))
                counts.append(np.minimum(np.bincount((s & np.uint64(CLASSES - 1)).astype("i8"), minlength=CLASSES), 255).astype("u1").tobytes())
                bits.append(parities(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(counts, pa.binary()), pa.array(bits, pa.binary())],
                names=["doc_id", "n", "h1", "h2", "counts", "bits"],
            )

    return bounded_batches(rows).mapInArrow(run, SKETCH)


def places(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Per document that may link to a different one: its regions.

    They would take more room on disk than the texts, so they are made again from the texts where they are needed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).where("node is not null and text is not null")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, ends = word_hashes(), rule.bands(1 << 20)
        for batch in batches:
            node, h1, keys = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, rule.width, known)
                if len(s) > ends[-3]:
                    ends = rule.bands(2 * len(s))
                own = region_keys(s, rule, ends)
                if len(own):
                    node.append(doc_id)
                    h1.append(int(mix(s, 23).sum(dtype="u8").view("i8")))
                    keys.append(own.view("i8"))
            values = pa.array(np.concatenate(keys) if keys else np.zeros(0, "i8"), pa.int64())
            bounds = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(h1, pa.int64()), pa.ListArray.from_arrays(bounds, values)], names=["node", "h1", "regions"])

    return bounded_batches(rows).mapInArrow(run, PLACES)


def near_pairs(counts, sizes, rule: Rule, leaf: int = 256, pivots: int = 8):
    """Pairs of rows (i, j) whose class counts differ in no more than linked sets may: a metric join by pivots."""
    import numpy as np

    counts = counts.astype("i2")
    reach = (rule.den - rule.num) * 2 * int(sizes.max()) // (rule.den + rule.num)
    found = []

    def far(some, one):
        return np.abs(counts[some] - counts[one]).sum(axis=1, dtype="i4")

    def direct(home, window):
        everyone = np.concatenate([home, window])
        if len(everyone) <= 48:  # few enough for one table of distances
            gap = np.abs(counts[home][:, None, :] - counts[everyone][None, :, :]).sum(axis=2, dtype="i4")
            most = (rule.den - rule.num) * (sizes[home][:, None] + sizes[everyone][None, :]) // (rule.den + rule.num)
            i, j = np.nonzero((gap <= most) & (np.arange(len(everyone))[None, :] > np.arange(len(home))[:, None]))
            found.append(np.stack([home[i], everyone[j]], axis=1))
            return
        for at, i in enumerate(home.tolist()):
            rest = everyone[at + 1 :]
            if len(rest):
                most = (rule.den - rule.num) * (sizes[rest] + sizes[i]) // (rule.den + rule.num)
                rest = rest[np.abs(sizes[rest] - sizes[i]) <= most]
                most = (rule.den - rule.num) * (sizes[rest] + sizes[i]) // (rule.den + rule.num)
                rest = rest[far(rest, i) <= most]
                if len(rest):
                    found.append(np.stack([np.full(len(rest), i), rest], axis=1))

    def join(home, window):
        """All near pairs within ``home`` and between ``home`` and ``window``."""
        if len(home) + len(window) <= leaf or len(home) < 2 * pivots:
            return direct(home, window)
        centres = home[np.linspace(0, len(home) - 1, pivots).astype("i8")]
        everyone = np.concatenate([home, window])
        distance = np.stack([far(everyone, c) for c in centres.tolist()], axis=1)
        own, nearest = distance.argmin(axis=1), distance.min(axis=1)
        is_home = np.arange(len(everyone)) < len(home)
        parts = []
        for p in range(pivots):
            inside = is_home & (own == p)
            # of two regions, the first has the second's nodes in its window
            near = (distance[:, p] <= nearest + 2 * reach) & ~inside & (~is_home | (own > p))
            parts.append((everyone[inside], everyone[near]))
        if max(len(a) + len(b) for a, b in parts) > 0.8 * len(everyone):  # pivots don't part these
            return direct(home, window)
        for a, b in parts:
            if len(a):
                join(a, b)
        return None

    join(np.arange(len(sizes)), np.zeros(0, "i8"))
    return np.concatenate(found) if found else np.zeros((0, 2), "i8")


def forest(pairs, ids):
    """A spanning forest of the pairs; links to small ids first, so that regions offer the same ones."""
    import numpy as np

    low, high = np.minimum(ids[pairs[:, 0]], ids[pairs[:, 1]]), np.maximum(ids[pairs[:, 0]], ids[pairs[:, 1]])
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in sorted(zip(low.tolist(), high.tolist(), strict=True)):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


OFFER = "a long, b long, region long, unit long"


def candidates(members: DataFrame, rule: Rule, later: bool) -> DataFrame:
    """Pairs of nodes that may link, from rows of ``region``, ``node``, ``n``, ``counts`` (and ``label``), region by region.

    First a spanning forest (``a``, ``b``), with a row (``region``, ``unit``) for each region that has candidates beyond it;
    ``later`` all candidates that would join two labels.
    """
    rows = members.select("region", "unit", "side", "node", "n", "counts", *(["label"] if later else []))
    rows = rows.repartition("region", "unit").sortWithinPartitions("region", "unit", "node")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def larger(lo, hi, side, ids, sizes, counts, labels, region, unit):
            """Offers of one region of more than two nodes."""
            if later and (labels[lo:hi] == labels[lo]).all():
                return []
            pairs = near_pairs(counts[lo:hi], sizes[lo:hi], rule) + lo
            apart = (side[pairs[:, 0]] != side[pairs[:, 1]]) | (side[pairs[:, 0]] == 2)  # pairs within a block have a unit of their own
            pairs = pairs[apart & (ids[pairs[:, 0]] != ids[pairs[:, 1]])]
            if later:
                pairs = pairs[labels[pairs[:, 0]] != labels[pairs[:, 1]]]
                return [(int(min(a, b)), int(max(a, b)), None, None) for a, b in zip(ids[pairs[:, 0]], ids[pairs[:, 1]], strict=True)]
            kept = forest(pairs, ids)
            return [(a, b, None, None) for a, b in kept] + ([(None, None, int(region[lo]), int(unit[lo]))] if len(pairs) > len(kept) else [])

        def offers(table):
            """Offers of whole regions, in rows next to each other."""
            region, unit, side, ids, sizes = (table.column(i).to_numpy() for i in range(5))
            flat = table.column(5).combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            counts = np.frombuffer(flat.buffers()[2], "u1")[flat.offset * CLASSES :][: len(flat) * CLASSES].reshape(-1, CLASSES)
            labels = table.column(6).to_numpy() if later else ids
            starts = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (unit[1:] != unit[:-1])]))
            many = np.diff(np.concatenate([starts, [len(ids)]]))
            # most regions hold two nodes: compared all at once
            i = starts[many == 2]
            i = i[(ids[i] != ids[i + 1]) & ((side[i] != side[i + 1]) | (side[i] == 2)) & ((labels[i] != labels[i + 1]) | (not later))]
            gap = np.abs(counts[i].astype("i2") - counts[i + 1]).sum(axis=1, dtype="i4")
            i = i[gap <= (rule.den - rule.num) * (sizes[i].astype("i8") + sizes[i + 1]) // (rule.den + rule.num)]
            got = [(a, b, None, None) for a, b in zip(np.minimum(ids[i], ids[i + 1]).tolist(), np.maximum(ids[i], ids[i + 1]).tolist(), strict=True)]
            for lo, m in zip(starts[many > 2].tolist(), many[many > 2].tolist(), strict=True):
                got += larger(lo, lo + m, side, ids, sizes.astype("i8"), counts, labels, region, unit)
            got = list(dict.fromkeys(got))
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], pa.int64()) for j in range(4)], names=["a", "b", "region", "unit"])

        tail = None  # the last region so far, which the next batch may go on with
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
                region, unit = table.column(0).to_numpy(), table.column(1).to_numpy()
                ends = np.flatnonzero((region != region[-1]) | (unit != unit[-1]))
                cut = int(ends[-1]) + 1 if len(ends) else 0
                if cut:
                    yield offers(table.slice(0, cut))
                tail = table.slice(cut)
        if tail is not None:
            yield offers(tail)

    return bounded_batches(rows).mapInArrow(run, OFFER).distinct()


def only(rows: DataFrame, keys: DataFrame, on: dict[str, str], keep: bool = True, most: int = 1_000_000, store: bool = True) -> DataFrame:
    """Rows whose columns (the keys of ``on``) are among ``keys``, or with ``keep=False`` are not.

    At most ``most`` keys are sent to all tasks, so the rows need no shuffle.  More are joined by a shuffle, and the rows are
    written down if they are read several times (``store``).
    """
    how, same = "left_semi" if keep else "left_anti", [F.col(a) == F.col(b) for a, b in on.items()]
    if keys.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keys), same, how)
    joined = rows.join(keys, same, how)
    return materialise(joined, "jaccard-only") if store else joined


def near_enough(pairs: DataFrame, made: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose parities differ in no more bits than linked sets may in shingles; ``made``: sketches of their nodes."""
    left = made.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = made.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb, xa, xb = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = pa.array([parity_gap(x, y) <= rule.differ(m, n) for m, n, x, y in zip(na, nb, xa, xb, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb")
    return bounded_batches(joined).mapInArrow(run, "a long, b long").distinct()


def ends_of(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.col("a").alias(name)).unionByName(pairs.select(F.col("b").alias(name))).distinct()


def verified(pairs: DataFrame, made: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose shingle sets link: by their parities first, then compared exactly."""
    pairs = materialise(near_enough(pairs, made, rule), "jaccard-near")
    ends = materialise(ends_of(pairs, "end"), "jaccard-ends")
    sets = materialise(_sets(only(texts, ends, {"node": "end"}, store=False), rule), "jaccard-sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(rule.den * both >= rule.num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return bounded_batches(joined, 256).mapInArrow(run, "a long, b long").distinct()


def crowded(nodes: DataFrame, block: int, every: int) -> DataFrame:
    """Regions that hold more than about ``block`` nodes, judged from one node in ``every``, and how many blocks they need."""
    sample = nodes.select(F.explode("regions").alias("region"))
    counted = sample.groupBy("region").agg(F.count("*").alias("seen")).where(F.col("seen") * every > block)
    return materialise(counted.select("region", F.ceil(F.col("seen") * every / block).cast("int").alias("blocks")), "jaccard-crowded")


def in_units(rows: DataFrame, crowds: DataFrame) -> DataFrame:
    """Rows of (region, node, ...) with the block pairs (``unit``) of crowded regions; side 2 where all pairs count."""
    rows = rows.join(crowds, "region", "left")
    mine = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    other = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(
            (F.least(i, mine) * F.col("blocks") + F.greatest(i, mine)).cast("long").alias("unit"), F.when(i == mine, 2).when(mine < i, 0).otherwise(1).alias("side")
        ),
    )
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("unit"), F.lit(2).alias("side")))
    return rows.withColumn("u", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(other))).withColumns({"unit": F.col("u.unit"), "side": F.col("u.side")}).drop("u", "blocks")


def jaccard_groups(
    docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text", block: int = 2048, every: int = 16,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that links reach."""
    made = materialise(sketches(docs, rule, id_col, text_col), "jaccard-sketches")
    filled = made.where("n > 0 and doc_id is not null")
    # 1. equal sets are one node, called by its smallest id
    node = filled.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    copied = materialise(node.where("copies > 1").select(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "node"), "jaccard-copies")
    named = made.select("doc_id", "n", "h1", "h2").join(copied, (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    named = materialise(named.select("doc_id", "n", "h1", F.coalesce("node", "doc_id").alias("node")), "jaccard-named")
    gone = materialise(named.where("n > 0 and node <> doc_id").select(F.col("doc_id").alias("gone"), F.col("h1").alias("gone_h1")).distinct(), "jaccard-gone")
    copy = {"node": "gone", "h1": "gone_h1"}
    nodes = only(filled.select(F.col("doc_id").alias("node"), "n", "h1", "counts"), gone, copy, keep=False).drop("h1")
    # 2, 3. regions that hold two nodes or more
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(every)) == 0)
    crowds = crowded(only(places(some, rule, id_col, text_col), gone, copy, keep=False), block, every)
    dealt = in_units(only(places(docs, rule, id_col, text_col), gone, copy, keep=False).select("node", F.explode("regions").alias("region")), crowds)
    shared = materialise(_shared(dealt), "jaccard-regions")
    members = shared.join(nodes.select("node", "n", "counts"), "node")
    # 4. a forest of each region's candidates, and where there are more
    offers = materialise(candidates(members, rule, later=False), "jaccard-offers")
    offered = offers.where("a is not null").select("a", "b")
    crowd = materialise(offers.where("region is not null").select(F.col("region").alias("r"), F.col("unit").alias("u")), "jaccard-more")
    dense = materialise(shared.join(crowd, (F.col("region") == F.col("r")) & (F.col("unit") == F.col("u")), "left_semi"), "jaccard-dense")
    # 5, 6. parities and exact checks; then what may still join two groups
    meeting = materialise(ends_of(offered, "m").unionByName(dense.select(F.col("node").alias("m"))).distinct(), "jaccard-meeting")
    texts = only(docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")), meeting, {"node": "m"})
    met = only(filled.select("doc_id", "n", "bits"), meeting, {"doc_id": "m"})
    links = materialise(verified(offered, met, texts, rule), "jaccard-links")
    groups = components(links)
    members = dense.join(only(nodes.select("node", "n", "counts"), meeting, {"node": "m"}), "node")
    members = members.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = candidates(members, rule, later=True).select("a", "b").join(offered, ["a", "b"], "left_anti")
    more = materialise(verified(materialise(rest, "jaccard-offers"), met, texts, rule), "jaccard-links")
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    out = named.join(groups, "node", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("label", "node")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose (region, unit) holds another node as well."""
    rows = rows.select("region", "unit", "side", "node").repartition("region", "unit").sortWithinPartitions("region", "unit")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = None  # the row before this batch, and whether it is out already
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([last[0], batch]).combine_chunks().to_batches()[0] if last else batch
            region, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = (region[1:] == region[:-1]) & (unit[1:] == unit[:-1])
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            kept_last = bool(keep[-1])
            if last and last[1]:
                keep[0] = False
            yield batch.filter(pa.array(keep))
            last = batch.slice(batch.num_rows - 1, 1), kept_last

    return rows.mapInArrow(run, rows.schema)


def _sets(texts: DataFrame, rule: Rule) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        known = word_hashes()
        for batch in batches:
            made = [shingle_set(t, rule.width, known).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "shingles"])

    return bounded_batches(texts.select("node", "text")).mapInArrow(run, "node long, shingles binary")
