"""Surrogates for personal data and secrets, with DataFrame functions only.

One pattern finds the entities of a text; what stands between them is left alone.  Every
entity is reduced to units, (kind, canonical value): an address in lower case, the last
ten digits of a phone number, a surname, a given name with its gender.  A unit's
surrogate comes from a keyed hash, so one value has one surrogate in every document and
format, and is poured back into the shape it was found in: separators, case, country
code, card network and check digits, top-level domain, title, gender and script stay.

A name is one or more titles with the initials, particles and name words after them; the
last word is the surname.  Titles and particles stay.  Other mentions of its words in the
same text, written with a capital, get the same surrogates.

Distinct units are gathered once.  Where two share a surrogate, or a surrogate is
itself a value of the corpus, all but the first are hashed again at the next level until
none clash.  Texts look up only those few raised levels; all else is computed in place.

Null texts stay null, empty ones empty, and texts without entities are unchanged.
Columns other than the text are passed through.  Rows that repeat an id are each rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import free_name
from pyrogrid.session import stored

KEY = "pyrogrid-surrogates"
# Raised units are few; a longer list is joined instead of broadcast.
BROADCAST_RAISED = 10_000

# Titles that introduce a name, by the gender they tell.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κύριος"],
    "x": ["Dr", "Prof"],
}
# Consonants, vowels and endings of invented names, by script.
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"f": "a", "m": "on", "x": "el", "s": "er"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"f": "а", "m": "ин", "x": "ель", "s": "ов"}),
    "greek": ("βγδζκλμνπρστφ", "αειου", {"f": "α", "m": "ος", "x": "ις", "s": "ης"}),
}

# Runs of letters are entered at their start only and never given back, so no text takes quadratic time.
# A domain goes on to its last label that starts with two letters, and ends with that label's letters.  Labels are
# taken for good one after the other, as a loop that may give them back keeps a stack frame for each.
PLAIN_LABELS = r"(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+"
EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++{PLAIN_LABELS}\.(?=[A-Za-z]{{2}})(?:[A-Za-z0-9-]++{PLAIN_LABELS}\.(?=[A-Za-z]{{2}}))*+[A-Za-z]++"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = r"(?<=[=:\"' ])(?<=[=:][ ]{0,3}[\"']?)(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?)[A-Za-z0-9+/_.~-]{6,}+={0,2}"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d-])"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(.-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])"
TITLE = "(?:" + "|".join(t for titles in TITLES.values() for t in titles) + ")"
# Titles in a row, then name words with initials and particles between or before them; a possessive s is no part of a word.
SPACE = "[ \u00a0]"
TITLED = rf"(?:{TITLE}\.?{SPACE})++"
WORD = rf"(?!{TITLE}\.?{SPACE})\p{{Lu}}(?:\p{{L}}|['’-](?![sS](?!\p{{L}}))(?=\p{{L}}))++"
INITIALS = r"(?:(?:\p{Lu}\.-?)++(?:\p{Lu}(?![\p{L}.'’]))?|\p{Lu})(?![\p{L}'’])"
PARTICLE = rf"(?:von und zu|(?:von|van|vom|de|del|della|di|da|du|dos|ten|ter)(?:{SPACE}(?:der|den|dem|la|las|los|le))?)"
BEFORE = rf"(?:(?:{INITIALS}|{PARTICLE}){SPACE}|d['’]|\p{{Lu}}\.-?(?=\p{{Lu}}))*+"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLED}{BEFORE}{WORD}(?:{SPACE}{BEFORE}{WORD})*+"
# The parts of a name that are replaced.
TOKEN = rf"(?<!\p{{L}})(?:{INITIALS}|{WORD})"
MENTION = rf"(?<![\p{{L}}\p{{N}}]){WORD}"
ENTITY = "|".join([EMAIL, ACCESS_KEY, SECRET, ADDRESS, ACCOUNT, SOCIAL, CARD, PHONE, NAME])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _may_hold(text: Column) -> Column:
    """Cheap test that spares texts without any entity the full pattern."""
    titles = [t for own in TITLES.values() for t in own]
    found = text.rlike("[@=:0-9]")
    for title in titles:
        if not any(title != t and title.startswith(t) for t in titles):
            found = found | F.contains(text, F.lit(title))
    return found


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def kind_of(found: Column) -> Column:
    digits = F.length(_digits(found))
    return (
        F.when(F.contains(found, F.lit("@")), "email")
        .when(found.rlike(r"^AKIA[0-9A-Z]{16}$"), "key")
        .when(found.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(found.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{11,}$"), "account")
        .when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
        .when(found.rlike(r"^\d[\d -]{11,22}\d$") & digits.between(13, 19), "card")
        .when(found.rlike(r"^[+(\d][\d ().-]{8,}\d$") & digits.between(9, 16), "phone")
        .when(found.rlike(rf"^{TITLE}\.?{SPACE}"), "name")
        .otherwise("secret")
    )


def _gender(found: Column) -> Column:
    """Gender that any of the titles tells."""
    tells = {g: found.rlike(rf"^(?:{TITLE}\.?{SPACE})*(?:{'|'.join(titles)})\.?{SPACE}") for g, titles in TITLES.items()}
    return F.when(tells["f"], "f").when(tells["m"], "m").otherwise("x")


def _untitled(found: Column) -> Column:
    return F.regexp_replace(found, f"^{TITLED}", "")


def _tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _refilled(text: Column, pattern: str, new: Column) -> Column:
    """``text`` with the matches of ``pattern`` replaced by the values of ``new``."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def units_of(found: Column) -> Column:
    """Units of an entity: array of (kind, canon).  Initials are none, as too few letters are free for them."""
    return F.filter(_let(kind_of(found), lambda kind: _units(found, kind)), lambda u: u["kind"] != "initials")


def _units(found: Column, kind: Column) -> Column:
    plain = F.regexp_replace(found, r"[ ().+-]", "")
    canon = (
        F.when(kind == "email", F.lower(found))
        .when(kind == "ip", found)
        .when(kind == "phone", F.substring(_digits(found), -10, 10))
        .when(kind == "secret", found)
        .otherwise(plain)
    )
    gender = F.concat(F.lit("name_"), _gender(found))

    def of(words: Column) -> Column:
        # A name ends with its surname.
        part = lambda w, k: F.when(w.rlike(r"^\p{Lu}(?:\.|$)"), "initials").when(k == F.size(words) - 1, "name_s").otherwise(gender)
        return F.transform(words, lambda w, k: F.struct(part(w, k).alias("kind"), F.lower(w).alias("canon")))

    names = _let(_tokens(_untitled(found), TOKEN), of)
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _draws(key: str, kind: Column, canon: Column, level: Column, count: Column) -> Column:
    """Array of at least ``count`` numbers below 65,536, from the keyed hash of a unit."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, canon, level.cast("string"))
    # Sixteen numbers of each digest: every substring is of 64 characters, so long values take no quadratic time.
    block = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.conv(F.substr(digest, k * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    digests = F.transform(F.sequence(F.lit(0), F.floor(count / 16).cast("int")), lambda b: F.sha2(F.concat_ws("\u0001", seed, b.cast("string")), 256))
    return F.flatten(F.transform(digests, block))


def _pick(alphabet: str, draw: Column) -> Column:
    return F.substr(F.lit(alphabet), draw % len(alphabet) + 1, F.lit(1))


def _alike(value: Column, draws: Column, hexadecimal: Column) -> Column:
    """Each character replaced by one of its class; what is neither letter nor digit stays."""
    def one(c: Column, k: Column) -> Column:
        alphabet = (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), "0123456789abcdef")
            .when(c.rlike("[0-9]"), "0123456789")
            .when(c.rlike("[a-z]"), "abcdefghijklmnopqrstuvwxyz")
            .when(c.rlike("[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            .otherwise(c)
        )
        return _let(alphabet, lambda own: F.substr(own, F.element_at(draws, k + 1) % F.length(own) + 1, F.lit(1)))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    figures = F.split(F.reverse(digits), "")
    doubled = F.transform(figures, lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10


def _mod97(value: Column) -> Column:
    """Remainder by 97 of a string in which letters count from 10 on, as account numbers do."""
    def step(done: Column, c: Column) -> Column:
        number = F.conv(c, 36, 10).cast("int")
        return (done * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.split(value, ""), F.lit(0), step)


def _invented(kind: Column, canon: Column, draws: Column) -> Column:
    """A name of the unit's script and gender."""
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    out = F.lit("")
    for name, (consonants, vowels, endings) in SCRIPTS.items():
        syllables = [F.concat(_pick(consonants, F.element_at(draws, 2 * k + 1)), _pick(vowels, F.element_at(draws, 2 * k + 2))) for k in range(3)]
        ending = F.lit("")
        for gender, letters in endings.items():
            ending = F.when(kind == f"name_{gender}", letters).otherwise(ending)
        last = _pick(consonants, F.element_at(draws, 7))
        out = F.when(script == name, F.concat(*syllables, last, ending)).otherwise(out)
    return out


def _initials(canon: Column, draws: Column) -> Column:
    """Each letter replaced by another one of its script."""
    def one(c: Column, k: Column) -> Column:
        alphabet = F.when(c.rlike(r"\p{IsCyrillic}"), "абвгдежзиклмнопрстуфхцчшэюя").when(c.rlike(r"\p{IsGreek}"), "αβγδεζηθικλμνξοπρστυφχψω").otherwise("abcdefghijklmnopqrstuvwxyz")
        other = lambda own: F.substr(own, (F.position(c, own) + F.element_at(draws, k + 1) % (F.length(own) - 1)) % F.length(own) + 1, F.lit(1))
        return F.when(c.rlike(r"\p{L}"), _let(alphabet, other)).otherwise(c)

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def fresh(kind: Column, canon: Column, level: Column, key: str) -> Column:
    """The surrogate of a unit, in canonical form."""
    count = F.greatest(F.length(canon), F.lit(8))

    def of(draws: Column) -> Column:
        hexadecimal = (kind == "secret") & canon.rlike("^[0-9a-f]+$")
        octets = [(F.element_at(draws, k) % 223 + 1).cast("string") for k in range(1, 5)]
        return (
            F.when(kind == "ip", F.concat_ws(".", *octets))
            .when(kind == "initials", _initials(canon, draws))
            .when(F.startswith(kind, F.lit("name_")), _invented(kind, canon, draws))
            .otherwise(_let(_alike(canon, draws, hexadecimal), lambda alike: _shaped(kind, canon, level, key, draws, alike)))
        )

    return _let(_draws(key, kind, canon, level, count), of)


def _shaped(kind: Column, canon: Column, level: Column, key: str, draws: Column, alike: Column) -> Column:
    """``alike`` with what the kind prescribes: domain, first digits, check digits."""
    at = F.instr(canon, "@")
    first = F.element_at(draws, 1)

    def email(domain: Column) -> Column:
        labels = _let(_draws(key, F.lit("domain"), domain, level, F.length(domain)), lambda own: _alike(domain, own, F.lit(False)))
        local = F.substr(alike, F.lit(1), at - 1)
        return F.concat(local, F.lit("@"), F.regexp_replace(labels, r"\.[^.]*$", ""), F.lit("."), F.substring_index(domain, ".", -1))

    def card(body: Column) -> Column:
        # The last digit makes the sum of a valid number valid again.
        check = ((F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
        return F.concat(body, F.when(_luhn(canon) == 0, check).otherwise(F.substring(alike, -1, 1)))

    def account(rest: Column) -> Column:
        country = F.substring(canon, 1, 2)
        return F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest)

    return (
        F.when(kind == "email", _let(F.substr(canon, at + 1), email))
        .when(kind == "phone", F.concat((first % 8 + 2).cast("string"), F.substr(alike, F.lit(2))))
        .when(kind == "social", F.concat((first % 5 + 1).cast("string"), F.substr(alike, F.lit(2))))
        .when(kind == "card", _let(F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(alike, F.lit(2), F.length(canon) - 2)), card))
        .when(kind == "account", _let(F.substr(alike, F.lit(5)), account))
        .when(kind == "key", F.concat(F.lit("AKIA"), F.substr(alike, F.lit(5))))
        .otherwise(alike)
    )


def _pour(found: Column, value: Column) -> Column:
    """``found`` with its last letters and digits replaced by those of ``value``, case kept."""
    plain = "[^A-Za-z0-9]"

    def of(new: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), (F.length(new) - F.length(F.regexp_replace(found, plain, ""))).alias("at"))

        def step(done: Column, c: Column) -> Column:
            slot = c.rlike("[A-Za-z0-9]")
            at = done["at"] + F.when(slot, 1).otherwise(0)
            taken = F.substr(new, at, F.lit(1))
            shown = F.when(slot & (at > 0), F.when(c.rlike("[A-Z]"), F.upper(taken)).otherwise(taken)).otherwise(c)
            return F.struct(F.concat(done["out"], shown).alias("out"), at.alias("at"))

        return F.aggregate(F.split(found, ""), start, step)["out"]

    return _let(F.regexp_replace(value, plain, ""), of)


def _like(word: Column, name: Column) -> Column:
    """``name`` written in capitals or with one, as ``word`` is."""
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(name)).otherwise(F.initcap(name))


def _surrogate(unit: Column, levels: Column | None, key: str) -> Column:
    level = F.lit(0) if levels is None else F.coalesce(F.try_element_at(levels, F.concat_ws("\u0001", unit["kind"], unit["canon"])), F.lit(0))
    return fresh(unit["kind"], unit["canon"], level, key)


def replacement(found: Column, levels: Column | None, key: str) -> Column:
    """What an entity becomes; ``levels`` is a map from raised units to their level."""

    def shown(kind: Column, values: Column) -> Column:
        head, rest = F.regexp_extract(found, f"^{TITLED}", 0), _untitled(found)
        name = F.concat(head, _refilled(rest, TOKEN, F.zip_with(_tokens(rest, TOKEN), values, _like)))
        case = F.when(found == F.upper(found), F.upper(values[0])).otherwise(values[0])
        return F.when(kind == "name", name).when(kind.isin("email", "ip"), case).otherwise(_pour(found, values[0]))

    return _let(kind_of(found), lambda kind: _let(F.transform(_units(found, kind), lambda u: _surrogate(u, levels, key)), lambda values: shown(kind, values)))


def names_of(found: Column, levels: Column | None, key: str) -> Column:
    """(given, canon, value) of the name words among the entities of a text, surnames first."""
    own = F.array_distinct(F.flatten(F.transform(F.filter(found, lambda m: kind_of(m) == "name"), units_of)))
    return F.array_sort(F.transform(own, lambda u: F.struct((u["kind"] != "name_s").alias("given"), u["canon"].alias("canon"), _surrogate(u, levels, key).alias("value"))))


def _mentions(part: Column, names: Column) -> Column:
    """A stretch between entities, with mentions of ``names`` replaced."""
    def one(w: Column) -> Column:
        value = F.try_element_at(F.filter(names, lambda n: n["canon"] == F.lower(w)), F.lit(1))["value"]
        return F.when(value.isNull(), w).otherwise(_like(w, value))

    return _refilled(part, MENTION, F.transform(_tokens(part, MENTION), one))


def entities(text: Column) -> Column:
    """Entities of a text, in order (null text: none)."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(_may_hold(text), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))), none)


def units(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, canon) of a column of texts."""
    found = docs.select(F.explode(entities(F.col(text_col))).alias("found")).distinct()
    return found.select(F.inline(units_of(F.col("found")))).distinct()


def raised(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, level) of the units whose surrogate at level 0 is taken, at the first level that is not."""
    level = found.withColumn("level", F.lit(0))
    while True:
        named = stored(level.withColumn("surrogate", fresh(F.col("kind"), F.col("canon"), F.col("level"), key)), "units")
        # A surrogate that is a value of the corpus, or one that several units share: the least of them keeps it.
        real = named.select("kind", F.col("canon").alias("surrogate")).distinct()
        leaked = named.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon")
        shared = named.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("least")).filter("n > 1")
        later = named.join(shared, ["kind", "surrogate"]).filter("canon <> least").select("kind", "canon")
        clash = stored(leaked.unionByName(later).distinct(), "clash")
        if clash.isEmpty():
            return named.filter("level > 0").select("kind", "canon", "level")
        level = named.join(clash.withColumn("up", F.lit(1)), ["kind", "canon"], "left").select(
            "kind", "canon", (F.col("level") + F.coalesce("up", F.lit(0))).alias("level")
        )


def _levels(docs: DataFrame, lifted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, levels): the raised units of each document that has any."""
    few = lifted.count() <= BROADCAST_RAISED
    each = docs.select(F.col(id_col).alias("key"), F.explode(entities(F.col(text_col))).alias("found")).select("key", F.inline(units_of(F.col("found"))))
    hits = each.join(F.broadcast(lifted) if few else lifted, ["kind", "canon"]).select("key", F.concat_ws("\u0001", "kind", "canon").alias("unit"), "level").distinct()
    return hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("unit", "level"))).alias("levels"))


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and the kinds found, in order, as ``entity_kinds``.

    All other columns are passed through whatever their names; where ``docs`` has an
    ``entity_kinds`` of its own, the kinds get the first free name entity_kinds_1, ...
    A text of any length is one row's work; its time grows with its length and, where
    names occur, with its entities times its capitalised words.
    """
    taken = docs.columns
    kinds = free_name("entity_kinds", taken)
    own_key, own_levels, own_found, own_names = (free_name(n, taken) for n in ("_key", "_levels", "_found", "_names"))
    lifted = stored(raised(stored(units(docs, text_col), "units"), key), "raised")
    if lifted.isEmpty():
        joined, levels = docs, None
    else:
        own = _levels(docs, lifted, id_col, text_col).select(F.col("key").alias(own_key), F.col("levels").alias(own_levels))
        joined = docs.join(own, F.col(id_col).eqNullSafe(F.col(own_key)), "left").drop(own_key)
        levels = F.coalesce(F.col(own_levels), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    text, found, names = F.col(text_col), F.col(own_found), F.col(own_names)
    joined = joined.withColumn(own_found, entities(text))
    new = F.transform(found, lambda m: replacement(m, levels, key))
    joined = joined.withColumn(own_names, names_of(found, levels, key))
    between = F.split(text, ENTITY, -1)
    between = F.when(F.size(names) > 0, F.transform(between, lambda part: _mentions(part, names))).otherwise(between)
    parts = F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)
    shown = [changed.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*shown, F.transform(found, kind_of).alias(kinds))
