"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

An entity is found by pattern and typed.  Its surrogate is made from a keyed SHA-256 of its type and normal form, so one entity
has one surrogate in all documents (coreference), in the format it had: letters for letters of the same case and script,
digits for digits, separators kept, card numbers and account numbers with valid check digits if they had them, addresses and
networks in reserved ranges, given names of the same gender and script, family names of the same script.

Different entities must stay different: all distinct entities of the corpus are brought together with their surrogates;
where two share one, or one equals a real entity, all but the first are made anew with a counter, until none collide.  Only texts
that may hold an entity are joined with their surrogates, by document.

Defined cases: null text stays null and empty text empty; text without entities is returned as it is, byte for byte; rows that
repeat are replaced alike; null ids are ids like others; very long texts are read whole; an empty table stays empty; all
other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

# fixed values: titles by gender, given names by script and gender, syllables of family names by script
TITLES = {
    "m": "Mr Mister Herr Señor Sr Monsieur Signor Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Signora Госпожа Κυρία".split(),
    "x": "Dr Prof".split(),
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Paul Peter Hans Karl Jürgen Stefan Pierre Jean Louis Carlos José Miguel".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Emma Anna Laura Ursula Monika Petra Sabine Marie Claire Sophie Carmen Lucía Isabel".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παύλος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Βασιλική".split(),
}
SYLLABLES = {
    "latin": "ba be bro ca da del fa fer gar ho ja ka kel lan lor ma mer na nor pa per qui ra ro sa sel ta tor va ven wal zan".split(),
    "cyrillic": "ба ве гор да жа зи ка ли ма но па ро са ти фо ша".split(),
    "greek": "βα γο δα θε κα λι μα νο πα ρο σα τι φο χα".split(),
}
NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
# fixed values: what entities look like, the more special first
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth)\b)[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9+/_.~-]{6,}={0,2}",
    "cloud_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "token": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)",
    "name": "\\b(?=\\p{Lu})(?:(?:" + "|".join(t for g in TITLES.values() for t in g) + rf")\.?[ ]+{NAME}(?:[ ]{NAME})?|(?:" + "|".join(n for g in GIVEN.values() for n in g) + rf")[ ]{NAME})",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: no entity is without one of these
HINT = r"[@=:0-9]|\b(?:A[KS]IA|gh[pousr]_|xox|sk[-_]|eyJ)|\b(?=\p{Lu})(?:" + "|".join(x for g in (*TITLES.values(), *GIVEN.values()) for x in g) + r")\.?[ ]"
VALUE = r"^(.*?[=:][ \t]*[\"']?)(.*)$"


def kind_of(m: Column) -> Column:
    """The first type whose pattern is all of the match."""
    kinds = [(k, m.rlike(f"^(?:{p})$")) for k, p in PATTERNS.items()]
    out = F.lit("name")
    for k, is_kind in reversed(kinds[:-1]):
        out = F.when(is_kind, F.lit(k)).otherwise(out)
    return out


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def unit_of(kind: Column, m: Column) -> Column:
    """What must map to one surrogate wherever it stands: the entity in normal form (of names, the family name)."""
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "secret", F.regexp_extract(m, VALUE, 2))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(m, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "name", F.try_element_at(F.split(m, " +"), F.lit(-1)))
        .otherwise(m)
    )


def draw(h: Column, i: Column | int) -> Column:
    """A number below 65536 from place i of a digest."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(63)) * 4 + 1
    return F.conv(F.substr(h, at.cast("int"), F.lit(4)), 16, 10).cast("int")


def shaped(text: Column, h: Column, digits_only: bool = False, hexadecimal: Column | None = None) -> Column:
    """Each ASCII letter and digit replaced by one of its kind; everything else stays."""
    pick = lambda c, i, low, n: F.substr(F.lit(low), (F.pmod(draw(h, i), F.lit(n)) + 1).cast("int"), F.lit(1))
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def one(c, i):
        new = F.when(c.rlike("^[0-9]$"), pick(c, i, "0123456789", 10))
        if not digits_only:
            hexed = F.lit(False) if hexadecimal is None else hexadecimal
            new = new.when(c.rlike("^[a-z]$"), F.when(hexed, pick(c, i, small[:6], 6)).otherwise(pick(c, i, small, 26))).when(c.rlike("^[A-Z]$"), pick(c, i, large, 26))
        return new.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_rest(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.try_element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def card(m: Column, h: Column) -> Column:
    """A card number in the same grouping and of the same issuer digit; its check digit is valid if the old one was."""
    made = F.concat(F.substring(m, 1, 1), shaped(F.substr(m, F.lit(2), F.greatest(F.char_length(m) - 2, F.lit(0))), h, digits_only=True))
    digits = F.regexp_replace(made, r"\D", "")
    last = F.pmod(F.lit(10) - luhn_rest(F.concat(digits, F.lit("0"))), F.lit(10))
    valid = luhn_rest(F.regexp_replace(m, r"\D", "")) == 0
    last = F.when(valid, last).otherwise(F.pmod(last + 1 + F.pmod(draw(h, 61), F.lit(9)), F.lit(10)))
    return F.concat(made, last.cast("string"))


def iban(m: Column, h: Column) -> Column:
    """An account number of the same country and grouping with valid check digits."""
    made = F.concat(F.substring(m, 1, 2), F.lit("00"), shaped(F.substr(m, F.lit(5)), h))
    flat = F.regexp_replace(made, " ", "")
    turned = F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: ((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))
    return F.concat(F.substring(made, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(made, F.lit(5)))


def pick_from(words: list[str], n: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, words)), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


def family(word: Column, h: Column, tries: Column) -> Column:
    """Syllables of the word's script; every fourth try adds one, so that there are always more surrogates than words."""
    more = F.floor(tries / 4).cast("int")

    def of(script: str) -> Column:
        parts = [pick_from(SYLLABLES[script], draw(h, 7 * i + 1)) for i in range(5)]
        longer = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: pick_from(SYLLABLES[script], draw(h, i + 30))), "")).otherwise("")
        return F.initcap(F.concat(*parts[:3], F.when(F.char_length(word) > 6, parts[3]).otherwise(""), F.when(F.char_length(word) > 8, parts[4]).otherwise(""), longer))

    return F.when(script_of(word) == "cyrillic", of("cyrillic")).when(script_of(word) == "greek", of("greek")).otherwise(of("latin"))


def name(m: Column, h: Column, g: Column, key: str, tries: Column) -> Column:
    """Title kept, given name of the same gender and script, family name from ``h``.

    A listed given name moves on in its list by a step that the key sets, so different ones stay different; another is
    drawn by ``g``, its own digest.
    """
    words = F.split(m, " +")
    first, given = title_and_given(m)
    lists = {x: [n for (_, y), ns in GIVEN.items() if x == y for n in ns] for x in "mf"}
    n = F.conv(F.substring(g, 1, 6), 16, 10).cast("int")
    gender = F.when(first.isin(TITLES["m"]) | given.isin(lists["m"]), "m").when(first.isin(TITLES["f"]) | given.isin(lists["f"]), "f").otherwise(F.when(n % 2 == 0, "m").otherwise("f"))
    new = F.lit(None).cast("string")
    for (script, sex), names in GIVEN.items():
        step = int(hashlib.sha256(f"{key}/{script}/{sex}".encode()).hexdigest(), 16) % (len(names) - 1) + 1
        at = F.array_position(F.array(*map(F.lit, names)), given)
        other = F.when(at > 0, pick_from(names, at - 1 + step)).otherwise(pick_from(names, n))
        new = F.when((script_of(given) == script) & (gender == sex), other).otherwise(new)
    return F.concat_ws(" ", F.when(first.isNotNull(), F.try_element_at(words, F.lit(1))), F.when(given.isNotNull(), new), family(F.try_element_at(words, F.lit(-1)), h, tries))


def title_and_given(m: Column) -> tuple[Column, Column]:
    """The title without its dot and the given name; either may be null."""
    words = F.split(m, " +")
    head = F.regexp_replace(F.try_element_at(words, F.lit(1)), r"\.$", "")
    titled = head.isin([t for g in TITLES.values() for t in g])
    return F.when(titled, head), F.when(~titled, F.try_element_at(words, F.lit(1))).when(F.size(words) == 3, F.try_element_at(words, F.lit(2)))


def with_surrogates(forms: DataFrame, key: str) -> DataFrame:
    """``new`` for rows of ``kind``, ``unit``, ``m`` and ``tries``.  Digests are columns of their own, so each is made once."""
    part = lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "unit", F.col("tries").cast("string"), F.lit(str(i))), 256)
    forms = forms.withColumn("h", F.concat(*(part(i) for i in range(4))))
    forms = forms.withColumn("g", F.when(F.col("kind") == "name", F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("given"), title_and_given(F.col("m"))[1]), 256)))
    kind, m, h = F.col("kind"), F.col("m"), F.col("h")
    sides = F.split(F.lower(m), "@")
    domain = F.split(F.try_element_at(sides, F.lit(2)), r"\.")
    email = F.concat(shaped(F.try_element_at(sides, F.lit(1)), h), F.lit("@"), shaped(F.try_element_at(domain, F.lit(1)), F.reverse(h)), F.lit(".example."), F.try_element_at(domain, F.lit(-1)))
    value = F.regexp_extract(m, VALUE, 2)
    octet = lambda i: F.pmod(draw(h, i), F.lit(256)).cast("string")
    code = F.regexp_extract(m, r"^(\+\d{1,3})?", 0)
    new = (
        F.when(kind == "email", email)
        .when(kind == "secret", F.concat(F.regexp_extract(m, VALUE, 1), shaped(value, h, hexadecimal=value.rlike("^[0-9a-f]+$"))))
        .when(kind.isin("cloud_key", "token"), F.concat(F.substring(m, 1, 4), shaped(F.substr(m, F.lit(5)), h)))
        .when(kind == "iban", iban(m, h))
        .when(kind == "ssn", F.concat(F.lit("9"), shaped(F.substr(m, F.lit(2)), h, digits_only=True)))
        .when(kind == "ipv4", F.concat_ws(".", (F.pmod(draw(h, 0), F.lit(15)) + 240).cast("string"), octet(1), octet(2), octet(3)))
        .when(kind == "phone", F.concat(code, shaped(F.substr(m, F.char_length(code) + 1), h, digits_only=True)))
        .when(kind == "card", card(m, h))
        .otherwise(name(m, h, F.col("g"), key, F.col("tries")))
    )
    return forms.withColumn("new", new).drop("h", "g")


def entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every distinct (document, entity): ``doc``, ``m`` as it stands, ``kind`` and ``unit``."""
    found = docs.where(F.col(text_col).rlike(HINT)).select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(ALL), 0))).alias("m"))
    return found.withColumn("kind", kind_of(F.col("m"))).withColumn("unit", unit_of(F.col("kind"), F.col("m")))


def counters(units: DataFrame, key: str) -> DataFrame:
    """``kind``, ``unit`` and ``tries`` such that no two units share a surrogate and none gets a real unit's form."""
    units = units.withColumn("tries", F.lit(0))
    while True:
        made = with_surrogates(units, key).withColumn("form", unit_of(F.col("kind"), F.col("new")))
        made = materialise(made.drop("new"), "surrogates")
        # of the units that share a surrogate, the first stays
        first = made.groupBy(F.col("kind").alias("k"), F.col("form").alias("n")).agg(F.min(F.struct("tries", "unit")).alias("keeps"), F.count("*").alias("many")).where("many > 1")
        real = made.select(F.col("kind").alias("rk"), F.col("unit").alias("ru"))
        again = made.join(first, (F.col("kind") == F.col("k")) & (F.col("form") == F.col("n")), "left").join(real, (F.col("kind") == F.col("rk")) & (F.col("form") == F.col("ru")), "left")
        clash = (F.col("many").isNotNull() & (F.col("keeps.unit") != F.col("unit"))) | F.col("ru").isNotNull()
        again = materialise(again.select("kind", "unit", "m", clash.alias("clash"), (F.col("tries") + clash.cast("int")).alias("tries")), "surrogates")
        if again.where("clash").isEmpty():
            return again.select("kind", "unit", "tries")
        units = again.drop("clash")


def replace_entities(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """The documents with surrogates in their text, and how many entities were replaced.

    Texts without a hint of an entity go straight through; only the others are joined with their surrogates.
    """
    found = materialise(entities(docs, id_col, text_col), "entities")
    forms = found.select("kind", "unit", "m").distinct()
    tries = counters(forms.groupBy("kind", "unit").agg(F.min("m").alias("m")), key)
    new = materialise(with_surrogates(forms.join(tries, ["kind", "unit"]), key).select("m", "new"), "surrogates")
    own = found.join(new, "m").groupBy(F.col("doc").alias("__doc")).agg(F.map_from_entries(F.collect_set(F.struct("m", "new"))).alias("__new"))
    own = materialise(own, "document-surrogates")
    text = F.col(text_col)
    hint = F.coalesce(text.rlike(HINT), F.lit(False))
    plain = docs.where(~hint).withColumn(count_col, F.lit(0))
    rows = docs.where(hint).join(own, F.col(id_col).eqNullSafe(F.col("__doc")), "left")
    matches = F.regexp_extract_all(text, F.lit(ALL), 0)
    joined = F.array_join(F.zip_with(F.split(text, ALL, -1), F.transform(matches, lambda m: F.try_element_at("__new", m)), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    rows = rows.withColumn(count_col, F.when(F.col("__new").isNull(), 0).otherwise(F.size(matches))).withColumn(text_col, F.when(F.col("__new").isNull(), text).otherwise(joined))
    return rows.select(*docs.columns, count_col).unionByName(plain)
