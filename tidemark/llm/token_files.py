"""Token ids in compressed binary files with one trained zstandard dictionary and an offset index.

Each document is serialised as little-endian ids (2 bytes where the vocabulary allows, else 4) and compressed as a frame of
its own with a shared dictionary, so one short document is read and decompressed alone.  A file begins with a header that
holds the id width and the dictionary's SHA-256; the index (a table) holds place, size and token counts of every document.
Files hold ascending document ids; shard numbers follow their order.

Defined cases: null text is empty (its ids are the end id alone); null ids come first; rows with the same id keep one
record each, ordered by text; very long texts are records like others, tokenised piece by piece; an empty table gives an
empty index; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded_batches, materialise, worker_table
from tidemark.llm.files import Appender, open_folder, read_ranges

MAGIC = b"TDMKIDS1"
INDEX = "doc_id long, shard int, in_shard long, n_tokens long, file string, offset long, length long"


class Encoder:
    """Token ids of whole texts with the tokenizers library, for a batch of texts at a time.

    Byte-level BPE starts a new unit before a single space that a non-space follows, and where a run of letters ends; no
    merge crosses a unit.  So every distinct word of a batch is encoded once and its ids are laid out wherever it stands.
    Words stay in a table of bounded size for the next batch.  A text in which white space follows a space, or which holds the text of
    an added token, goes to the library whole.  Either way the ids are those that the library gives for the whole text.
    """

    def __init__(self, path: str, keep_words: int = 700_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.bpe = self.whole.model
        self.keep, self.words, self.tails = keep_words, {}, {}
        # byte-level BPE shows bytes that do not print as the characters from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}

    def of_text(self, texts: list[str]) -> list[bytes]:
        from array import array

        return [array("I", x.ids).tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Ids of a space and a run of letters."""
        from array import array

        text = "\u0120" + (word if word.isascii() else word.encode().decode("latin-1").translate(self.shown))
        return array("I", [x.id for x in self.bpe.tokenize(text)]).tobytes()

    def of_word(self, piece: str) -> bytes:
        """Ids of a space and the piece."""
        if piece.isalpha():
            return self._letters(piece)
        at = 0
        while at < len(piece) and piece[at].isalpha():
            at += 1
        if not at:
            return self.of_text([f" {piece}"])[0]
        head, tail = piece[:at], piece[at:]
        if tail not in self.tails:
            if len(self.tails) >= self.keep:
                self.tails.clear()
            self.tails[tail] = self.of_text([tail])[0]
        return (self.words.get(head) or self._letters(head)) + self.tails[tail]

    def batch(self, texts, end_id: int):
        """Ids of all texts one after the other, ``end_id`` after each, and where each text starts (one entry more)."""
        import numpy as np
        import pyarrow.compute as pc

        pieces = pc.split_pattern(texts, " ")
        bounds = pieces.offsets.to_numpy()
        coded = pieces.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = (bounds - bounds[0]).astype("i8")
        distinct, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype("i8")
        n_texts, odd, found = len(texts), np.zeros(len(distinct), bool), []
        if len(self.words) >= self.keep:
            self.words.clear()
        for i, piece in enumerate(distinct):
            ids = self.words.get(piece)
            if ids is None:
                if not piece or piece[0].isspace():
                    odd[i], ids = True, b""
                else:
                    ids = self.words[piece] = self.of_word(piece)
            found.append(ids)
        # the first piece of a text has no space before it; it gets an entry of its own
        first = bounds[:-1]
        entry = np.where(np.isin(np.arange(len(place)), first), 0, 1) * (place + 1)
        alone = np.logical_or.reduceat(odd[place] & (entry > 0), first) if n_texts else np.zeros(0, bool)
        for token in self.added:
            alone |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        starts = self.of_text([distinct[i] for i in place[first].tolist()]) if n_texts else []
        for i in np.flatnonzero(alone).tolist():
            starts[i] = self.of_text([texts[i].as_py()])[0]
        entry[alone[np.repeat(np.arange(n_texts), np.diff(bounds))]] = 0  # a text encoded whole has no other pieces
        entry[first] = len(distinct) + 2 + np.arange(n_texts)
        table = [b"", *found, int(end_id).to_bytes(4, "little"), *starts]
        sizes = np.fromiter(map(len, table), "i8", len(table)) // 4
        ids = np.frombuffer(b"".join(table), "<u4")
        begins = np.cumsum(sizes) - sizes
        order = np.full(len(place) + n_texts, len(distinct) + 1, "i8")
        order[np.arange(len(place)) + np.repeat(np.arange(n_texts), np.diff(bounds))] = entry
        run = sizes[order]
        ends = np.cumsum(run)
        at = np.repeat(begins[order] - (ends - run), run) + np.arange(ends[-1] if len(ends) else 0)
        return ids[at], np.concatenate([[0], ends[bounds[1:] + np.arange(n_texts)]]) if n_texts else np.zeros(1, "i8")


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    return worker_table(f"encoder {path}", lambda: Encoder(path))


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, sample_bytes: int, dictionary_bytes: int) -> bytes:
    """A dictionary from serialised id arrays of at most ``sample_bytes`` characters of text, chosen by hash.

    The sample is the only thing bounded here: it sets how well files compress, never what they hold.
    """
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    share = 1.0 if size <= sample_bytes else sample_bytes / size
    # texts are cut into pieces of 8 KB, and every piece has the same chance
    piece = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / 8192).cast("int")))
    cut = docs.where("text is not null").select("doc_id", "text", piece.alias("i"))
    rank = F.xxhash64("doc_id", "i", F.length("text"))
    picked = cut.where(F.pmod(rank, F.lit(1 << 40)) < int(share * (1 << 40))).select(F.substr("text", F.col("i") * 8192 + 1, F.lit(8192)).alias("text"), rank.alias("rank"))

    def train(batches):
        import pyarrow as pa
        import zstandard

        samples = []
        for batch in batches:
            ids, at = encoder(tokenizer_path).batch(batch.column(0), end_id)
            raw = ids.astype(f"<u{width}").tobytes()
            samples += [raw[width * a : width * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        try:
            blob = zstandard.train_dictionary(dictionary_bytes, samples).as_bytes() if len(samples) >= 32 else b""
        except zstandard.ZstdError:  # too little or too even a sample: files then go without a dictionary
            blob = b""
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    # one task for the bounded sample; its rows are pieces
    rows = picked.repartition(1).sortWithinPartitions("rank", "text").mapInArrow(train, "blob binary").collect()
    return max((bytes(r["blob"]) for r in rows), key=len, default=b"")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    file_bytes: int = 256 << 20, sample_bytes: int = 2 << 20, dictionary_bytes: int = 64 << 10, level: int = 3,
) -> DataFrame:
    """Write the documents' ids below ``folder`` and return the index (a table of the shared scratch folder)."""
    import hashlib

    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, tokenizer_path, end_id, width, sample_bytes, dictionary_bytes)
    mark = hashlib.sha256(dictionary).digest()
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{mark.hex()}.dict") as out:
        out.write(dictionary)
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        out = Appender(folder, f"ids-{shard:06d}", ".tok", file_bytes, MAGIC + bytes([width]) + mark)
        total = 0
        try:
            for batch in batches:
                got = []
                ids, bounds = encoder(tokenizer_path).batch(batch.column(1), end_id)
                raw = memoryview(ids.astype(f"<u{width}").tobytes())
                for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    frame = press.compress(raw[width * a : width * b])
                    file, at = out.add(frame)
                    got.append((doc_id, shard, total, b - a, file, at, len(frame)))
                    total += b - a
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*got, strict=True)) or [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            out.close()

    return materialise(bounded_batches(ordered, 1024).mapInArrow(write, INDEX), "token-index")


def with_start(index: DataFrame) -> DataFrame:
    """The ids before each document: its place in the shard plus the sum of all earlier shards (a row for each shard)."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = shards.select("shard", (F.sum("held").over(Window.orderBy("shard")) - F.col("held")).alias("before"))
    return index.join(materialise(before, "token-shards"), "shard").withColumn("start", F.col("before") + F.col("in_shard")).drop("before")


def read_token_files(index: DataFrame, folder: str, *, with_ids: bool = True) -> DataFrame:
    """The documents that the index rows name: ids and, as a check sum, the CRC of them as 32-bit integers.

    Extra columns of the index (such as ``start``) are kept.  A file whose dictionary is not the one its header names is
    refused.
    """
    keep = [c for c in index.columns if c not in ("shard", "in_shard")]
    index = index.select(*keep).sortWithinPartitions("file", "offset")
    extra = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields if f.name not in ("file", "offset", "length", "n_tokens"))
    schema = f"{extra}, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches):
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa
        import zstandard

        fs, path = open_folder(folder)
        heads: dict = {}
        machines: dict = {}

        def machine(file):
            if file not in heads:
                heads.clear()
                with fs.open_input_file(f"{path}/{file}") as source:
                    head = source.read(len(MAGIC) + 33)
                if head[:8] != MAGIC:
                    raise ValueError(f"{file} is not a token file")
                heads[file] = head[8], head[9:]
            width, mark = heads[file]
            if mark not in machines:
                with fs.open_input_file(f"{path}/{mark.hex()}.dict") as source:
                    blob = source.read()
                if hashlib.sha256(blob).digest() != mark:
                    raise ValueError(f"{file} names another dictionary")
                machines[mark] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(blob) if blob else None)
            return width, machines[mark]

        for batch in batches:
            at = {n: batch.column(n).to_pylist() for n in ("file", "offset", "length", "n_tokens")}
            counts, sums, ids = [], [], []
            for file, n, frame in zip(at["file"], at["n_tokens"], read_ranges(folder, zip(at["file"], at["offset"], at["length"], strict=True)), strict=True):
                width, unpack = machine(file)
                values = np.frombuffer(unpack.decompress(frame), f"<u{width}").astype("<u4")
                if len(values) != n:
                    raise ValueError(f"{file}: {n} ids expected, {len(values)} read")
                counts.append(len(values))
                sums.append(zlib.crc32(values.tobytes()))
                if with_ids:
                    ids.append(values.astype("i4"))
            columns = [batch.column(n) for n in batch.schema.names if n not in at] + [pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            names = [n for n in batch.schema.names if n not in at] + ["n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return index.mapInArrow(read, schema)


def token_round_trip(spark: SparkSession, docs: DataFrame, folder: str, tokenizer_path: str, **options) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32."""
    index = with_start(write_token_files(docs, folder, tokenizer_path, **options))
    return read_token_files(index, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
