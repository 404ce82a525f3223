"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected entities are reduced to an identity (digits of a phone number, lower-cased address,
...). Every distinct identity gets a surrogate of its type from a keyed digest: the same
identity the same surrogate in all texts, two identities never one surrogate, and none that
is itself an identity of the input. What the text shows is the surrogate in the format of
the mention: punctuation, grouping, letter case, title and script stay.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabellion.llm.common import written

_SECRET_NAME = (
    r"(?i:(?<![A-Za-z])(?=[tspa])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)"
    r"[\"']? {0,2}[=:] {0,2}[\"']?)"
)
_MEN = "Mr Herr Monsieur Señor Sr Signor Г-н Господин".split()
_WOMEN = "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Señorita Signora Г-жа Госпожа".split()
_MALE, _FEMALE = ("|".join([*titles, *map(str.upper, titles)]) for titles in (_MEN, _WOMEN))
# the first letter is tested before the titles are tried one by one
_INITIALS = "".join(sorted({title[0] for title in [*_MEN, *_WOMEN, "Dr", "Prof"]}))
_TITLE = rf"(?=[{_INITIALS}])(?:{_MALE}|{_FEMALE}|Dr|Prof)\.?"
_NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}"

#: kinds in the order in which they are tried at a place of the text
KINDS = {
    # a domain has 127 labels at most; the engine recurses once per turn of the group
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    # one of the first 512 characters is a digit: with no bound a run of names would be read anew from each of them
    "secret": _SECRET_NAME + r"(?=[^\s\"'<>,;]{0,511}[0-9])[^\s\"'<>,;]{6,}",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    r"|\+[0-9]{7,15}(?![0-9])",
    "person": rf"(?<!\p{{L}}){_TITLE} {_NAME}",
}
PATTERN = "|".join(KINDS.values())
#: what every entity holds; texts without it are passed on untouched
_HINT = rf"[0-9@]|(?<!\p{{L}}){_TITLE} \p{{Lu}}"

#: fixed values: common given names by gender and script
GIVEN = {
    ("male", "latin"): ["James", "Peter", "Thomas", "Daniel", "Martin", "Lucas", "Felix", "Oscar", "Simon", "Victor"],
    ("female", "latin"): ["Anna", "Maria", "Laura", "Julia", "Clara", "Emma", "Sofia", "Helen", "Nora", "Alice"],
    ("male", "cyrillic"): ["Иван", "Пётр", "Сергей", "Олег", "Павел", "Антон", "Максим", "Роман"],
    ("female", "cyrillic"): ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Вера", "Нина", "Дарья"],
    ("male", "greek"): ["Γιώργος", "Νίκος", "Κώστας", "Πέτρος"],
    ("female", "greek"): ["Μαρία", "Ελένη", "Άννα", "Σοφία"],
}
#: syllables that family names are built from, by script
SYLLABLES = {
    "latin": ["ba", "den", "fer", "gal", "hol", "kar", "lan", "mor", "nel", "per", "ros", "san", "tor", "vel", "win", "zan"],
    "cyrillic": ["ба", "ден", "вер", "гал", "кар", "лан", "мор", "нел", "пер", "рос", "сан", "тор", "вел", "зан", "дон", "рин"],
    "greek": ["βα", "δεν", "φερ", "γαλ", "καρ", "λαν", "μορ", "νελ", "περ", "ρος", "σαν", "τορ", "βελ", "ζαν", "δον", "ριν"],
}
#: attempts after which a surrogate grows by one character, for kinds whose values run out
PATIENCE = 16


def _kind(mention: Column) -> Column:
    return reduce(
        lambda rest, name: F.when(mention.rlike(f"^(?:{KINDS[name]})$"), name).otherwise(rest),
        reversed(KINDS),
        F.lit("person"),
    )


def _secret(mention: Column) -> Column:
    return F.regexp_replace(mention, "^" + _SECRET_NAME, "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _gender(mention: Column) -> Column:
    return F.when(mention.rlike(rf"^(?:{_FEMALE})\.? "), "female").when(mention.rlike(rf"^(?:{_MALE})\.? "), "male")


def _script(name: Column) -> Column:
    return (
        F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    )


def _identity(kind: Column, mention: Column) -> Column:
    """What makes two mentions of a kind the same entity."""
    value = _secret(mention)
    name = F.lower(F.regexp_replace(mention, rf"^{_TITLE} ", ""))
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("secret", "hex"), F.when(value.rlike("^[0-9A-Fa-f]+$"), F.lower(value)).otherwise(value))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "ip", mention)
        .when(kind == "phone", F.concat(F.regexp_extract(mention, r"^\+?", 0), _digits(mention)))
        .when(kind == "person", F.concat_ws("|", F.coalesce(_gender(mention), F.lit("")), name))
        .otherwise(_digits(mention))
    )


def _family(kind: Column) -> Column:
    """Kinds that share identities: a secret keeps its surrogate with and without its name."""
    return F.when(kind == "hex", "secret").otherwise(kind)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)


def _byte(stream: Column, at: Column) -> Column:
    return F.conv(F.substr(stream, (at % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number % len(values) + 1)


def _stream(*parts: Column) -> Column:
    """256 hexadecimal digits that key and parts determine."""
    text = F.concat_ws("\x1f", *parts)
    return F.concat(*[F.sha2(F.concat(text, F.lit(f"\x1f{i}")), 256) for i in range(4)])


def _replaced(text: Column, stream: Column, keep: int, hexadecimal: Column | None = None) -> Column:
    """``text`` with every letter and digit after the first ``keep`` characters drawn anew in its own class."""

    def one(char: Column, at: Column) -> Column:
        byte = _byte(stream, at)
        other = (
            F.when(char.rlike("[0-9]"), _pick(list("0123456789"), byte))
            .when(char.rlike("[a-z]"), _pick(list("abcdefghijklmnopqrstuvwxyz"), byte))
            .when(char.rlike("[A-Z]"), _pick(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte))
            .otherwise(char)
        )
        if hexadecimal is not None:
            other = F.when(hexadecimal, _pick(list("0123456789abcdef"), byte)).otherwise(other)
        return F.when(at < keep, char).otherwise(other)

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""

    def one(digit: Column, at: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(at % 2 == 0, digit.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.reverse(_chars(digits)), one), F.lit(0), lambda a, b: a + b) % 10


def _syllable(values: list[str], stream: Column, at: Column) -> Column:
    return _pick(values, _byte(stream, at))


def _surrogate(family: Column, identity: Column, stream: Column, domain_stream: Column, attempt: Column) -> Column:
    """A candidate of the same type as ``identity``."""
    longer = F.concat(identity, F.repeat(F.lit("0"), F.floor(attempt / PATIENCE).cast("int")))
    domain = F.regexp_extract(identity, "@(.+)$", 1)
    hidden = F.concat(
        _replaced(F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), domain_stream, 0),
        F.regexp_extract(domain, r"\.[^.]+$", 0),
    )
    local = F.concat(F.regexp_extract(identity, "^([^@]*)@", 1), F.regexp_extract(longer, "@[^@]*?(0*)$", 1))
    octets = [(_byte(stream, F.lit(0)) % 223 + 1), *[_byte(stream, F.lit(i)) for i in (1, 2, 3)]]
    card = _replaced(longer, stream, 1)
    fixed = F.concat(F.expr("''"), F.substr(card, F.lit(1), F.length(card) - 1))
    check = (F.lit(10) - _luhn(F.concat(fixed, F.lit("0")))) % 10
    name = F.regexp_extract(identity, r"\|(.*)$", 1)
    gender = F.coalesce(
        F.when(identity.startswith("female|"), "female").when(identity.startswith("male|"), "male"),
        F.when(_byte(stream, F.lit(9)) % 2 == 0, "female").otherwise("male"),
    )
    given, family_name = F.lit(None).cast("string"), F.lit(None).cast("string")
    script = _script(name)
    for (sex, letters), values in GIVEN.items():
        given = F.when((gender == sex) & (script == letters), _pick(values, _byte(stream, F.lit(0)))).otherwise(given)
    extra = F.floor(attempt / PATIENCE).cast("int")
    for letters, values in SYLLABLES.items():
        parts = F.transform(F.sequence(F.lit(1), 3 + extra), partial(_syllable, values, stream))
        built = F.initcap(F.array_join(parts, ""))
        family_name = F.when(script == letters, built).otherwise(family_name)
    spoken = F.when(name.contains(" "), F.concat_ws(" ", given, family_name)).otherwise(family_name)
    return (
        F.when(family == "email", F.concat(_replaced(local, stream, 0), F.lit("@"), hidden))
        .when(family == "secret", _replaced(longer, stream, 0, identity.rlike("^[0-9a-f]+$")))
        .when(family == "iban", _replaced(longer, stream, 2))
        .when(family == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
        .when(family == "card", F.when(_luhn(identity) == 0, F.concat(fixed, check.cast("string"))).otherwise(card))
        .when(family == "phone", _replaced(longer, stream, 2))
        .when(family == "person", F.concat_ws("|", F.regexp_extract(identity, r"^(.*)\|", 1), spoken))
        .otherwise(_replaced(longer, stream, 0))
    )


def _shown(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention."""
    digits = _digits(surrogate)
    filled = F.array_join(
        F.transform(
            _chars(mention),
            lambda char, at: F.when(
                char.rlike("[0-9]"),
                F.substr(digits, F.length(_digits(F.substr(mention, F.lit(1), at + 1))), F.lit(1)),
            ).otherwise(char),
        ),
        "",
    )
    rest = F.substr(digits, F.length(_digits(mention)) + 1, F.length(digits))
    spaced = F.array_join(
        F.transform(
            _chars(mention),
            lambda char, at: F.when(char == " ", char).otherwise(
                F.substr(surrogate, F.length(F.regexp_replace(F.substr(mention, F.lit(1), at + 1), " ", "")), F.lit(1))
            ),
        ),
        "",
    )
    value = _secret(mention)
    named = F.regexp_extract(mention, "^" + _SECRET_NAME, 0)
    upper = value.rlike("[A-Z]") & ~value.rlike("[a-z]")
    title = F.regexp_extract(mention, rf"^{_TITLE} ", 0)
    name = F.regexp_extract(surrogate, r"\|(.*)$", 1)
    loud = F.regexp_replace(mention, rf"^{_TITLE} ", "")
    return (
        F.when(kind == "email", F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(surrogate))
        .when(
            kind.isin("secret", "hex"),
            F.concat(named, F.when(upper & surrogate.rlike("^[0-9a-f]+$"), F.upper(surrogate)).otherwise(surrogate)),
        )
        .when(kind == "iban", F.concat(spaced, F.substr(surrogate, F.length(F.regexp_replace(mention, " ", "")) + 1, F.length(surrogate))))
        .when(kind == "ip", surrogate)
        .when(kind == "person", F.concat(title, F.when(loud == F.upper(loud), F.upper(name)).otherwise(name)))
        .otherwise(F.concat(filled, rest))
    )


def surrogates(identities: DataFrame, key: str) -> DataFrame:
    """(family, identity, surrogate) for distinct rows (family, identity).

    In rounds: every identity without a surrogate draws a candidate; a candidate that is an
    identity itself, is taken, or was drawn by several identities (one of them keeps it) is
    drawn again with the next attempt, until all differ.
    """
    known = written(identities.select("family", "identity").distinct(), "identities")
    pending, placed, attempt = known, None, 0
    while True:
        family, identity = F.col("family"), F.col("identity")
        drawn = pending.select(
            "*",
            _stream(F.lit(key), family, identity, F.lit(str(attempt))).alias("_stream"),
            _stream(F.lit(key), F.lit("domain"), F.regexp_extract(identity, "@(.+)$", 1)).alias("_domain"),
        )
        drawn = drawn.select(
            "family",
            "identity",
            _surrogate(family, identity, F.col("_stream"), F.col("_domain"), F.lit(attempt)).alias("surrogate"),
        )
        free = drawn.join(
            known.select("family", F.col("identity").alias("surrogate")), ["family", "surrogate"], "left_anti"
        )
        if placed is not None:
            free = free.join(placed.select("family", "surrogate"), ["family", "surrogate"], "left_anti")
        won = free.groupBy("family", "surrogate").agg(F.min("identity").alias("identity"))
        won = won.select("family", "identity", "surrogate")
        placed = written(won if placed is None else placed.unionByName(won), "surrogates")
        pending = written(known.join(placed, ["family", "identity"], "left_anti"), "pending")
        attempt += 1
        if pending.isEmpty():
            return placed


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, mention) for every distinct text and distinct entity mention in it."""
    hits = docs.where(F.col(text).rlike(_HINT)).select(
        F.md5(F.col(text)).alias("digest"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0).alias("found")
    )
    return hits.select("digest", F.explode("found").alias("mention")).distinct()


def pseudonymise(docs: DataFrame, key: str, text: str = "text", keep_count: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; all other columns and rows unchanged.

    ``keep_count`` names a column for the number of replaced mentions (replaced if there).
    Null and empty texts stay as they are. Equal texts are searched once; a text's mentions
    are looked up by its digest, so keys may be null or repeat, and only texts with entities
    are shuffled.
    """
    spotted = written(mentions(docs, text), "mentions")
    kinds = spotted.select("mention").distinct().withColumn("kind", _kind(F.col("mention")))
    kinds = kinds.withColumn("family", _family(F.col("kind")))
    kinds = written(kinds.withColumn("identity", _identity(F.col("kind"), F.col("mention"))), "kinds")
    drawn = surrogates(kinds, key)
    shown = kinds.join(drawn, ["family", "identity"]).select(
        "mention", _shown(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("shown")
    )
    table = (
        spotted.join(shown, "mention")
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.map_from_entries(F.collect_list(F.struct("mention", "shown"))).alias("_shown"))
    )
    has = F.coalesce(F.col(text).rlike(_HINT) & F.col(text).rlike(PATTERN), F.lit(False))
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0)
    gaps = F.split(F.col(text), PATTERN, -1)
    parts = F.zip_with(
        gaps, F.concat(F.col("_found"), F.array(F.lit(""))), lambda gap, m: F.concat(gap, F.coalesce(F.col("_shown")[m], m))
    )
    names = [c for c in docs.columns if c != keep_count]
    changed = (
        docs.where(has)
        .withColumn("_digest", F.md5(F.col(text)))
        .join(table, "_digest")
        .withColumn("_found", found)
        .withColumn("_text", F.array_join(parts, ""))
        .withColumn("_count", F.size("_found"))
    )
    changed = changed.select(
        *[F.col("_text").alias(c) if c == text else F.col(c) for c in names],
        *([F.col("_count").alias(keep_count)] if keep_count else []),
    )
    same = docs.where(~has).select(*names, *([F.lit(0).alias(keep_count)] if keep_count else []))
    return changed.unionByName(same)
