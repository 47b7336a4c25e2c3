"""Language identification by n-gram filters that return language bit masks.

A bit-sliced Bloom filter holds, at every position, one bit per language; the AND over an n-gram's positions gives all
languages that contain it.  A text's n-grams are counted per language, each count is corrected for that language's rate
of false positives, and the largest count decides.

Learned from a sample of at most ``train_docs`` labelled texts per language (whole texts, chosen by hash): an n-gram belongs
to a language if it is seen ``min_count`` times there and its share there is at least ``min_share`` of its share in the language
where it is commonest.  The sample bounds the filter; predictions cover every text, whole.

Defined cases: null text and text without a letter give ``und`` with score 0; without any labelled text nothing is learned and
all is ``und``; text whose n-grams are all unknown gives the language with most labelled texts and score 0; ties go to the
language that has more labelled texts, then to the smaller name; rows that repeat are predicted alike; other columns of the
input pass through only if they are named in ``keep``.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, materialise, worker_table

UNKNOWN = "und"


@dataclasses.dataclass
class LanguageFilter:
    """The filter: a mask of languages (bit j of word j // 64) at each position."""

    languages: list[str]
    masks: bytes  # positions x words of ``dtype``
    dtype: str
    words: int
    positions: int
    hashes: int
    rates: list[float]  # of false positives, per language
    sizes: Sequence[int]  # of n-grams


def letter_codes():
    """Per code point: its lower-case letter, or a space (kept by the worker process)."""
    import numpy as np

    def make():
        table = np.full(0x110000, 32, "<u4")
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        return table

    return worker_table("letters", make)


def text_codes(texts: Sequence[str]):
    """Letters of all texts, in lower case, runs of anything else as one space; each text has a space at both ends.

    Returns the codes and where each text starts (one entry more).
    """
    import numpy as np

    sizes = np.fromiter((len(t) + 2 for t in texts), "i8", len(texts))
    raw = "".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass")
    codes = letter_codes()[np.frombuffer(raw, "<u4")]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    keep[starts[:-1][sizes > 0]] = True
    ends = starts[1:] - 1
    keep[ends] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept_before[starts]


def mixed(h):
    import numpy as np

    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes, starts, n: int):
    """The n-grams of each text that hold a letter, as 64-bit hashes, and the text of each."""
    import numpy as np

    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    wide = codes.astype("u8")
    h = np.full(m, n, "u8")
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + m]
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = owner[:m] == owner[n - 1 : n - 1 + m]
    return mixed(h[whole]), owner[:m][whole]


def places(h, k: int, positions: int):
    """The k positions of each hash; ``positions`` is a power of two."""
    import numpy as np

    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(positions - 1)).astype("i8") for i in range(k)]


def train_language_filter(
    labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 1500,
    sizes: Sequence[int] = (3, 5), min_count: int = 3, min_share: float = 0.25, hashes: int = 2, bits_per_gram: int = 12,
) -> LanguageFilter:
    """Learn the filter.  Per language at most about ``train_docs`` texts are read, however large the table."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("language")).alias("rank")
    )
    counts = sorted(((-r["n"], r["lang"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()))
    languages = [lang for _, lang in counts]
    if not languages:
        return LanguageFilter([], b"", "u1", 1, 1, hashes, [], tuple(sizes))
    steps = 1 << 30
    share = F.create_map(*(x for n, lang in counts for x in (F.lit(lang), F.lit(max(1, int(min(1.0, train_docs / -n) * steps))))))
    sample = rows.where(F.pmod("rank", F.lit(steps)) < share[F.col("lang")]).select("text", F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int").alias("no"))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            no = np.array(batch.column(1).to_pylist(), "i8")
            codes, starts = text_codes(batch.column(0).to_pylist())
            for n in sizes:
                h, owner = gram_hashes(codes, starts, n)
                for own in np.unique(no).tolist():
                    got, times = np.unique(h[no[owner] == own], return_counts=True)
                    columns = got.view("i8"), np.full(len(got), own), times, np.full(len(got), n)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["gram", "no", "n", "size"])

    grams = bounded_batches(sample).mapInArrow(count, "gram long, no long, n long, size long").groupBy("gram", "no").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    grams = materialise(grams.where(F.col("n") >= min_count), "language-grams")
    totals = {(r["no"], r["size"]): r["n"] for r in grams.groupBy("no", "size").agg(F.sum("n").alias("n")).collect()}
    total = F.create_map(*(x for (no, size), n in sorted(totals.items()) for x in (F.lit(f"{no}/{size}"), F.lit(float(n))))) if totals else F.lit(None).cast("map<string,double>")
    shares = grams.withColumn("share", F.col("n") / total[F.concat_ws("/", "no", "size")])
    held = shares.groupBy("gram").agg(F.collect_list(F.struct("no", "share")).alias("held"), F.max("share").alias("most"))  # a row for each language at most
    held = held.select("gram", F.transform(F.filter("held", lambda x: x["share"] >= min_share * F.col("most")), lambda x: x["no"] - 1).alias("nos"))
    held = materialise(held, "language-masks")
    n_grams = held.count()
    positions = 1 << max(10, (max(1, n_grams) * bits_per_gram - 1).bit_length())
    words = -(-len(languages) // 64)
    dtype = next(t for t, bits in (("u1", 8), ("u2", 16), ("u4", 32), ("u8", 64)) if len(languages) <= bits or bits == 64)

    def fill(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        masks = np.zeros((positions, words), dtype)
        for batch in batches:
            gram = batch.column(0).to_numpy().view("u8")
            nos = batch.column(1)
            owner = np.repeat(np.arange(len(gram)), np.diff(nos.offsets.to_numpy()))
            no = nos.flatten().to_numpy()
            for at in places(gram[owner], hashes, positions):
                np.bitwise_or.at(masks, (at, no // 64), np.left_shift(np.ones(1, dtype), (no % 64).astype(dtype)))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(masks.tobytes(), 1)], pa.binary())], names=["blob"])

    import zlib

    import numpy as np

    # the filter has a size bound by the sample; a handful of tasks fill it and the driver ORs their parts
    masks = np.zeros((positions, words), dtype)
    for row in held.coalesce(4).mapInArrow(fill, "blob binary").toLocalIterator():
        masks |= np.frombuffer(zlib.decompress(bytes(row["blob"])), dtype).reshape(positions, words)
    rates = [float(((masks[:, j // 64] >> masks.dtype.type(j % 64)) & 1).mean()) ** hashes for j in range(len(languages))]
    return LanguageFilter(languages, masks.tobytes(), dtype, words, positions, hashes, rates, tuple(sizes))


def predict_language(docs: DataFrame, model: LanguageFilter, keep: Sequence[Column], *, text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, then ``lang_pred`` and ``score`` (the winner's share of all corrected counts)."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(c.alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        masks = np.frombuffer(m.masks, m.dtype).reshape(-1, m.words) if m.languages else None
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            codes, starts = text_codes(texts)
            letters = np.add.reduceat(codes != 32, starts[:-1]) if len(texts) else np.zeros(0, "i8")
            lang, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if m.languages and len(texts):
                seen, total = np.zeros((len(texts), len(m.languages))), np.zeros(len(texts))
                for n in m.sizes:
                    h, owner = gram_hashes(codes, starts, n)
                    total += np.bincount(owner, minlength=len(texts))
                    hit = None
                    for at in places(h, m.hashes, m.positions):
                        hit = masks[at] if hit is None else hit & masks[at]
                    if hit is not None:
                        for j in range(len(m.languages)):
                            seen[:, j] += np.bincount(owner[(hit[:, j // 64] >> hit.dtype.type(j % 64)) & 1 == 1], minlength=len(texts))
                rate = np.array(m.rates)
                real = np.maximum(0, seen - total[:, None] * rate) / np.maximum(1e-9, 1 - rate)
                best, held = real.argmax(axis=1), real.sum(axis=1)
                share = np.where((held > 0) & (letters > 0), real.max(axis=1) / np.maximum(held, 1e-12), 0.0)
                lang = [m.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(share, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)]) + ", lang_pred string, score double"
    return bounded_batches(rows).mapInArrow(score, schema)
