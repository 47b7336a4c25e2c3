"""Repair of conversation structure by the cheapest edits, decided by one integer shortest path.

A conversation should read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.  Per turn one may Keep it
(0), Rerole it to user or assistant (2) or Delete it (3; blank and repeated turns must go), and anywhere Insert an empty turn of the
user or assistant (2); a truncated turn that stays adds 1.  Among the cheapest repairs the one whose edit initials come first in
ASCII order wins.

**Method.**  The DAG has a node per gap between turns and per state (nothing yet, after s, after u, after a).  An edge passes one
turn: up to two inserts, then the turn's own edit.  Its weight is one integer: the cost in the high digits, and in the
low digits, at the three places that belong to this turn, the letters of the edge, padded with zeros at the end.  The letters of
an edge end with one of D, K, R, which no other letter follows inside the edge, so no edge's letters start another's and
comparing the padded digits of two paths is comparing their letters.  After the last turn come inserts only, where an end is
a zero and so less than a letter.  Weights add up without carries, so the ordinary minimum over integer sums decides cost,
edits and ties alike.  Inserts in front of a turn that must go are left out: the same inserts behind it cost the same and come later in
ASCII order.

**On Spark.**  Conversations of at most ``whole_rows`` turns and ``whole_chars`` characters are shuffled once by their id, sorted, and
folded in a stream.  Larger ones are sorted by range over all tasks and cut into blocks; a block yields, for each pair of states at
its edges, the least cost and the place of its digits among the block's own (4 x 4 small integers, since digits of one block have one
width).  A scan over these, from the last block to the first, gives each state's cost and rank among the four, which is all that a
comparison needs; a scan forwards picks the states; the blocks then run again between known states.  So no task holds a large conversation.
Its audit is one value, and its SHA-256 is made by one task, since that hash is sequential; rows stream through it.

Defined cases: a null role or text is one space; null turns come first and count for no gap; turns with one number are ordered by
role, then by the SHA-256 of their text; a null conversation id is a conversation of its own; roles count by their first character, and
an empty one fits nowhere; conversations that lose all turns have zeros, an empty audit and the hash of no text; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, materialise

#: fixed values: costs of the edits, and what a truncated turn that stays adds
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: letters as digits, in ASCII order; zero is the padding
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in DIGIT.items()}
BASE, PLACES = 8, 3
BITS = 3 * PLACES  # BASE**PLACES = 2**BITS
#: states by the last role written: nothing, system, user, assistant; what may follow, and where the conversation may end
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
NAME = {"u": "user", "a": "assistant"}
OK_PAIRS = ("su", "ua", "au")

SPACE = r"\x20\x09-\x0D"


# --- one conversation, or one block of it ----------------------------------------------------


def _inserted(state: int) -> list[tuple[int, int]]:
    """(number of inserts, state after them) for up to two inserts."""
    out, here = [(0, state)], state
    for n in (1, 2):
        role = "a" if here == USER else "u"
        here = NEXT[here][role]
        out.append((n, here))
    return out


def edges(initial: str, gone: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """All ways past one turn: (state before, state after, cost, letters)."""
    if gone:
        return [(s, s, DELETE, "D") for s in range(4)]
    out = []
    for s in range(4):
        for n, here in _inserted(s):
            stay, letters = n * INSERT + TRUNCATED * truncated, "I" * n
            out.append((s, here, n * INSERT + DELETE, letters + "D"))
            after = NEXT[here]
            if initial in after:
                out.append((s, after[initial], stay + KEEP, letters + "K"))
            out += [(s, after[r], stay + REROLE, letters + "R") for r in NAME if r in after]
    return out


def endings() -> list[tuple[int, int, int, str]]:
    return [(s, here, n * INSERT, "I" * n) for s in range(4) for n, here in _inserted(s) if here in ENDS]


def digits(letters: str) -> int:
    """The letters as a number of PLACES digits, zeros at the end."""
    value = 0
    for i in range(PLACES):
        value = value * BASE + (DIGIT[letters[i]] if i < len(letters) else 0)
    return value


_TABLE: dict = {}


def _weighed(initial: str, gone: bool, truncated: bool) -> list[tuple[int, int, int, int]]:
    """Edges past such a turn, with digits in place of letters; only the least per pair of states."""
    key = (initial if initial in ("s", "u") or initial == "a" else "", gone, truncated)
    if key not in _TABLE:
        best: dict = {}
        for s, t, cost, letters in edges(*key):
            best[s, t] = min(best.get((s, t), (cost, digits(letters))), (cost, digits(letters)))
        _TABLE[key] = [(s, t, *w) for (s, t), w in best.items()]
    return _TABLE[key]


def shortest(turns: list[tuple[str, bool, bool]], begin: int, final: bool) -> list[int | None]:
    """Least weight from ``begin`` to every state behind the turns (and, if ``final``, behind the last inserts).

    Weight = cost * BASE**width + digits, where width counts the places of all turns of this call and the ending.
    """
    places = BITS * (len(turns) + final)
    value: list[int | None] = [0 if s == begin else None for s in range(4)]
    for i, turn in enumerate(turns):
        right = places - BITS * (i + 1)
        value = _step(value, _weighed(*turn), places, right)
    if final:
        value = _step(value, [(s, t, c, digits(x)) for s, t, c, x in endings()], places, 0)
    return value


def _step(value: list, ways: list, places: int, right: int) -> list:
    after: list = [None] * 4
    for s, t, cost, code in ways:
        if value[s] is not None:
            w = value[s] + (cost << places) + (code << right)
            if after[t] is None or w < after[t]:
                after[t] = w
    return after


def letters_of(weight: int, slots: int) -> tuple[int, list[str]]:
    """Cost and the letters of every slot of a path's weight."""
    places = BITS * slots
    raw = (weight & ((1 << places) - 1)).to_bytes((places + 7) // 8 or 1, "big")
    bits = int.from_bytes(raw, "big")
    text = format(bits, f"0{places}b") if places else ""
    out = []
    for i in range(slots):
        slot = text[i * BITS:(i + 1) * BITS]
        out.append("".join(LETTER[d] for d in (int(slot[j:j + 3], 2) for j in range(0, BITS, 3)) if d))
    return weight >> places, out


def solve(turns: list[tuple[str, bool, bool]]) -> tuple[int, list[str]]:
    """Cost and letters per turn (the last entry: inserts at the end) of the best repair of a whole conversation."""
    found = [w for w in shortest(turns, START, True) if w is not None]
    return letters_of(min(found), len(turns) + 1)


def written(state: int, letters: str, role: str, text: str) -> tuple[int, list[str]]:
    """The repaired lines that one slot yields, and the state after them."""
    lines = []
    for letter in letters:
        if letter == "K":
            state = NEXT[state][role[:1]]
            lines.append(f"{role}:{text}")
        elif letter in "RI":
            to = "a" if state == USER else "u"
            state = NEXT[state][to]
            lines.append(f"{NAME[to]}:{text if letter == 'R' else ''}")
    return state, lines


# --- turns after damage ----------------------------------------------------------------------


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The contract's damage, by the crc32 of ``conv:turn``: drop, empty, strip ends, repeat, or make it a user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    out = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), mark.alias("mark"))
    out = out.where("mark <> 0").withColumns(
        {
            "role": F.when(F.col("mark") == 4, "user").otherwise(F.col("role")),
            "text": F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        }
    )
    copies = F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("copy", F.explode(copies)).drop("mark", "copy")


def judged(rows: DataFrame) -> DataFrame:
    """``turn``s with a digest that stands for their text, and whether they are blank or end without a mark."""
    said = F.regexp_extract("text", rf"(?s)([^{SPACE}])[{SPACE}]*$", 1)
    blank = ~F.col("text").rlike(rf"[^{SPACE}]")
    return rows.withColumns({"sha": F.sha2("text", 256), "blank": blank, "truncated": ~blank & ~said.isin(".", "!", "?")})


class Tally:
    """Counts over the turns of a conversation, or of a part of it, in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated and not duplicate and not blank
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in OK_PAIRS
        self.last = initial


RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
FIELDS = [part.split()[0] for part in RESULT.split(", ")]


def _typed(conv_type: str) -> str:
    return RESULT.replace("conv_id long", f"conv_id {conv_type}")


def whole_conversations(rows: DataFrame, conv_type: str) -> DataFrame:
    """Repairs conversations that fit a task: one shuffle, one sorted scan."""

    def finish(conv, held):
        import hashlib

        tally, seen, turns = Tally(), set(), []
        numbers = [t for t, *_ in held if t is not None]
        for _, role, _, sha, blank, truncated in held:
            again = (role, sha) in seen
            seen.add((role, sha))
            tally.add(role[:1], blank, again, truncated)
            turns.append((role[:1], blank or again, truncated))
        cost, audit = solve(turns)
        state, lines = START, []
        for letters, row in zip(audit, [*held, (None, "", "", "", True, False)], strict=True):
            state, new = written(state, letters, row[1], row[2])
            lines += new
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        return (conv, gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, "".join(audit), digest)

    def fold(batches):
        import pyarrow as pa

        current, held = (), []
        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if current != (row[0],):
                    if held:
                        done.append(finish(current[0], held))
                    current, held = (row[0],), []
                held.append(row[1:])
            if done:
                yield _rows(done, pa)
        if held:
            yield _rows([finish(current[0], held)], pa)

    def _rows(done, pa):
        kinds = [conv_arrow(), *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=FIELDS)

    conv_arrow = _arrow_of(conv_type)
    ready = judged(rows).select("conv_id", "turn", "role", "text", "sha", "blank", "truncated")
    placed = ready.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "sha")
    return bounded_batches(placed).mapInArrow(fold, _typed(conv_type))


def _arrow_of(conv_type: str):
    def kind():
        import pyarrow as pa

        return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[conv_type]

    return kind


# --- conversations that no task should hold --------------------------------------------------

BLOCK_ROWS = 4096
SALTS = 16


def _first_of_equals(rows: DataFrame) -> DataFrame:
    """Numbers equal turns (number, role, text) and finds the first number of every role and text; nothing is grouped into one task.

    Equal turns are made one row with a count, by partial aggregation; the first number of a role and text as well, and it goes back to the
    rows over salts, as one sentence may fill a conversation.
    """
    one = rows.groupBy("conv_id", "turn", "role", "sha").agg(
        F.first("text").alias("text"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.count("*").alias("n")
    )
    one = materialise(one, "turns")
    rank = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn"))
    firsts = one.groupBy("conv_id", "role", "sha").agg(F.min(rank).alias("least"), F.count("*").alias("numbers")).where("numbers > 1")
    firsts = firsts.select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("sha").alias("__s"), "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = one.withColumn("__salt_of", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    on = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("sha") == F.col("__s")) & (F.col("__salt_of") == F.col("__salt"))
    out = salted.join(firsts, on, "left")
    again = F.coalesce(F.col("least") != rank, F.lit(False))
    return out.select("conv_id", "turn", "role", "sha", "text", "blank", "truncated", "n", again.alias("again"))


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """All turns in order over all tasks; ``at`` rises with the order, ``block`` cuts a conversation into short parts."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = _first_of_equals(rows).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "sha", "copy"]
    placed = each.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    duplicate = F.col("again") | (F.col("copy") > 1)
    return materialise(placed.select("conv_id", "turn", "role", "text", "blank", "truncated", duplicate.alias("duplicate"), "at", F.floor(F.col("at") / block_rows).alias("block")), "turn-blocks")


def _by_group(batches, keys: int):
    """Runs of rows with one key, from batches sorted by it: (key, rows)."""
    current, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != current:
                if held:
                    yield current, held
                current, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield current, held


def _stream(df: DataFrame, keys: list[str], by: list, fn, schema: str) -> DataFrame:
    """Rows dealt by key, sorted, and passed through ``fn`` as they come."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *by).mapInArrow(fn, schema)


def _table(rows: list, names: list[str], kinds: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def large_conversations(rows: DataFrame, conv_type: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repairs conversations of any size in blocks."""
    conv_arrow = _arrow_of(conv_type)
    turns = _blocks(judged(rows), block_rows)
    light = turns.select("conv_id", "block", "at", F.substring("role", 1, 1).alias("initial"), "blank", "duplicate", "truncated")

    def summary(batches):
        """Per block its counts and, per pair of states, the least cost and the place of its digits among all of the block's."""
        import pyarrow as pa

        names = ["conv_id", "block", "cost", "place", "blank", "duplicate", "truncated", "illegal", "first", "last"]
        kinds = [conv_arrow(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.int64()] * 4, pa.string(), pa.string()]
        for (conv, block), held in _by_group(batches, 2):
            tally, some = Tally(), []
            for _, initial, blank, again, cut in held:
                tally.add(initial, blank, again, cut)
                some.append((initial, blank or again, cut))
            found = [w for s in range(4) for w in shortest(some, s, False)]
            low = (1 << (BITS * len(some))) - 1
            order = {d: i for i, d in enumerate(sorted({w & low for w in found if w is not None}))}
            cost = [None if w is None else w >> (BITS * len(some)) for w in found]
            place = [None if w is None else order[w & low] for w in found]
            yield _table([(conv, block, cost, place, tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.first, tally.last)], names, kinds)

    schema = f"conv_id {conv_type}, block long, cost array<long>, place array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string"
    blocks = materialise(_stream(light, ["conv_id", "block"], ["at"], summary, schema), "block-sums")

    def backward(batches):
        """From the last block to the first: which state to leave a block in, for every state it may be entered in."""
        import pyarrow as pa

        names, kinds = ["conv_id", "back", "leave", "total"], [conv_arrow(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        current, value = None, None
        for batch in batches:
            out = []
            for conv, back, cost, place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if current != (conv,):
                    current = (conv,)
                    last = sorted({digits(x) for *_, x in endings()})
                    value = [min((c, last.index(digits(x))) for s, _, c, x in endings() if s == state) if any(s == state for s, *_ in endings()) else None for state in range(4)]
                leave, fresh = [], []
                for s in range(4):
                    ways = [((cost[4 * s + t] + value[t][0], place[4 * s + t], value[t][1]), t) for t in range(4) if cost[4 * s + t] is not None and value[t] is not None]
                    leave.append(min(ways)[1] if ways else None)
                    fresh.append(min(ways)[0] if ways else None)
                ranks = {r: i for i, r in enumerate(sorted({w[1:] for w in fresh if w}))}
                value = [(w[0], ranks[w[1:]]) if w else None for w in fresh]
                out.append((conv, back, leave, [w[0] if w else None for w in value]))
            yield _table(out, names, kinds)

    up = _stream(blocks.select("conv_id", (-F.col("block")).alias("back"), "cost", "place"), ["conv_id"], ["back"], backward, f"conv_id {conv_type}, back long, leave array<int>, total array<long>")
    choices = materialise(up.select("conv_id", (-F.col("back")).alias("block"), "leave", "total"), "block-choices")

    def forward(batches):
        import pyarrow as pa

        names, kinds = ["conv_id", "block", "enter", "exit", "final", "cost"], [conv_arrow(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
        current, state, held = None, None, None
        for batch in batches:
            out = []
            for conv, block, leave, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and current != (conv,):
                    out.append((*held[:4], True, held[5]))
                elif held:
                    out.append(held)
                fresh = current != (conv,)
                if fresh:
                    current, state = (conv,), START
                held = (conv, block, state, leave[state], False, total[START] if fresh else None)
                state = leave[state]
            yield _table(out, names, kinds)
        if held:
            yield _table([(*held[:4], True, held[5])], names, kinds)

    ways = _stream(choices, ["conv_id"], ["block"], forward, f"conv_id {conv_type}, block long, enter int, exit int, final boolean, cost long")
    ways = materialise(ways, "block-ways")

    def fill(batches):
        """The letters of every turn, in blocks between known states; the end's inserts go with the last turn."""
        import pyarrow as pa

        names, kinds = ["at", "letters", "enter", "tail"], [pa.int64(), pa.string(), pa.int32(), pa.string()]
        for _, held in _by_group(batches, 2):
            some = [(initial, blank or again, cut) for _, initial, blank, again, cut, *_ in held]
            enter, leave, final = held[0][5:8]
            weight = shortest(some, enter, False)[leave]
            _, letters = letters_of(weight, len(some))
            tail = min((c, digits(x), x) for s, _, c, x in endings() if s == leave)[2] if final else ""
            out, state = [], enter
            for i, (row, slot) in enumerate(zip(held, letters, strict=True)):
                out.append((row[0], slot, state, tail if i + 1 == len(held) else ""))
                state = written(state, slot, row[1], "")[0]
            yield _table(out, names, kinds)

    on = light["conv_id"].eqNullSafe(ways["conv_id"]) & (light["block"] == ways["block"])
    entered = light.join(ways, on).select(light["conv_id"], light["block"], "at", "initial", "blank", "duplicate", "truncated", "enter", "exit", "final")
    letters = materialise(_stream(entered, ["conv_id", "block"], ["at"], fill, "at long, letters string, enter int, tail string"), "turn-letters")

    def digest(batches):
        import hashlib

        import pyarrow as pa

        names, kinds = ["conv_id", "audit", "repaired_sha256"], [conv_arrow(), pa.string(), pa.string()]
        current, sha, audit, any_line = None, None, [], False
        for batch in batches:
            out = []
            for conv, _, role, text, slot, enter, tail in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if current != (conv,):
                    if current:
                        out.append((current[0], "".join(audit), sha.hexdigest()))
                    current, sha, audit, any_line = (conv,), hashlib.sha256(), [], False
                state, lines = written(enter, slot, role, text)
                lines += written(state, tail, "", "")[1]
                audit.append(slot + tail)
                for line in lines:
                    sha.update((("\n" if any_line else "") + line).encode())
                    any_line = True
            if out:
                yield _table(out, names, kinds)
        if current:
            yield _table([(current[0], "".join(audit), sha.hexdigest())], names, kinds)

    said = turns.select("conv_id", "at", "role", "text").join(letters, "at").select("conv_id", "at", "role", "text", "letters", "enter", "tail")
    done = _stream(said, ["conv_id"], ["at"], digest, f"conv_id {conv_type}, audit string, repaired_sha256 string")
    spans = turns.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    # pairs that meet at an edge between two blocks; the table has a row per block
    blocks = blocks.withColumn("edge", F.struct("block", "first", "last"))
    sums = blocks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.sort_array(F.collect_list("edge")).alias("edges"))
    met = F.aggregate(
        F.sequence(F.lit(2), F.size("edges")), F.lit(0).cast("long"),
        lambda n, i: n + F.when(F.concat(F.element_at("edges", i - 1)["last"], F.element_at("edges", i)["first"]).isin(*OK_PAIRS), 0).otherwise(1),
    )
    illegal = F.col("illegal") + F.when(F.size("edges") > 1, met).otherwise(F.lit(0))
    sums = sums.withColumn("illegal", illegal.cast("long")).drop("edges")
    costs = ways.where("cost is not null").select("conv_id", "cost")
    out = done
    for other in (spans, sums, costs):
        other = other.withColumnRenamed("conv_id", "__c")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    return out.select(*FIELDS)


# --- all of them -----------------------------------------------------------------------------


def repair_conversations(
    rows: DataFrame, turns: DataFrame, *, conv: str = "conv_id", whole_rows: int = BLOCK_ROWS, whole_chars: int = 32_000_000, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A result row for every conversation id of ``rows``; ``turns`` are its turns (``conv_id, turn, role, text``) after damage."""
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    per = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    large = materialise(per.where((F.col("n") > whole_rows) | (F.col("chars") > whole_chars)).select(F.col("conv_id").alias("__c")), "large-conversations")
    same: Column = F.col("conv_id").eqNullSafe(F.col("__c"))
    if large.isEmpty():
        done = whole_conversations(turns, conv_type)
    else:
        done = whole_conversations(turns.join(large, same, "left_anti"), conv_type)
        done = done.unionByName(large_conversations(turns.join(large, same, "left_semi"), conv_type, block_rows))
    every = rows.select(F.col(conv).alias("__c")).distinct()
    out = every.join(done, same, "left")
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes
    numbers = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in FIELDS[1:7]]
    return out.select(F.col("__c").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
