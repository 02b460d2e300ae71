"""Surrogates for personal data, as DataFrame expressions only.

Entities are found by one regular expression, and each distinct one gets a surrogate that
depends on a key, its type and its value: the same entity reads the same everywhere. A
surrogate has the type and the format of what it replaces: digits for digits, letters of
the script and case for letters, a valid check digit in card numbers (and any in other long
numbers), reserved domains in addresses, and names of the title's gender. Given and family names are entities of their
own, so ``Mr. Smith`` is still the ``Mr. John Smith`` of before.

Names are found behind titles; wherever else their words stand in the same text, before or
after, they get the same surrogates. A word that is a family and a given name in one text
reads as the family name there, and one of several genders as female, male, neutral.

Collision checks: of values that got one surrogate all but one try again, and so do those
whose surrogate occurs among the values. From ``WIDER`` attempts on surrogates grow, so that
small formats cannot run out of room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callshelf.llm.common import free_name
from callshelf.session import stage

# Titles by gender, as written before names.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "г-жа")
NEUTRAL_TITLES = ("Dr", "Prof")
_TITLES = "|".join((*FEMALE_TITLES, *MALE_TITLES, *NEUTRAL_TITLES))
_PARTICLES = "van|von|zu|zum|zur|de|der|den|des|del|della|di|da|do|dos|du|la|le|ten|ter|bin|ibn|al|el"
# A word of two letters or more, no title; quantifiers do not give back, so it ends where its letters do.
_WORD = (
    rf"(?!(?:{_TITLES})(?![\p{{L}}\p{{M}}]))(?=\p{{Lu}}['’-]?[\p{{L}}\p{{M}}])"
    r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+"
)
_BEFORE = rf"(?:(?:(?:\p{{Lu}}\.)+|{_PARTICLES}) )*"
_NAMES = rf"{_BEFORE}{_WORD}(?: {_BEFORE}{_WORD})*"

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
SECRET = (
    r"(?<=(?i:token|secret|password|api_key|apikey) ?[=:] ?[\"'])[^\"'\s]{8,}(?=[\"'])"
    r"|(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}(?![\p{L}\p{N}])"
)
IP = (
    r"(?<![\p{N}.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"
    r"(?!\d|\.\d)"
)
PHONE = (
    r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4}(?!\d))(?:[ .-]?\d{2,4}(?!\d)){1,4}"
    r"|(?<![\p{L}\p{N}])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
)
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])"
CARD = r"(?<![\p{L}\p{N}.+-])\d(?:[ -]?\d){12,18}(?![\p{N}])"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLES})\.? )+{_NAMES}"
#: In order of preference where two begin at one place.
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IP, PHONE, SSN, CARD, NAME))

#: What every match has in it. Much cheaper to search for, and most texts do not have it.
HINT = (
    r"@|\+\d|\d[\d.() -]{5,}\d|[0-9a-fA-F]{32}|(?i:token|secret|password|api_?key) ?[=:]"
    rf"|(?:{_TITLES})\.? (?:\p{{Lu}}|(?:{_PARTICLES}) )"
)

#: In order of preference for a name without a title.
_NAME_KINDS = ("family", "given_f", "given_m", "given_n")

WIDER = 6
MOST_ATTEMPTS = 40


def _all_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _is(value: Column, pattern: str) -> Column:
    return value.rlike(rf"^(?:{pattern})$")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _luhn_sum(digits: Column, check_included: bool) -> Column:
    """The Luhn sum of a digit string; without its check digit the doubling begins at the end."""
    letters = F.split(F.reverse(digits), "")
    first = 1 if check_included else 0

    def worth(digit: Column, place: Column) -> Column:
        doubled = digit.cast("int") * 2
        return F.when(
            place % 2 == first, F.when(doubled > 9, doubled - 9).otherwise(doubled)
        ).otherwise(digit.cast("int"))

    values = F.transform(F.filter(letters, lambda d: d != ""), worth)
    return F.aggregate(values, F.lit(0), lambda total, v: total + v)


def kind_of(match: Column) -> Column:
    """The type of a match, null where it is no entity after all."""
    plain = r"[^\"'\s]{8,}"
    return (
        F.when(_is(match, NAME.replace("(?<![\\p{L}\\p{N}])", "", 1)), "name")
        .when(match.contains("@") & _is(match, r".+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"), "email")
        .when(_is(match, r"\d{1,3}(?:\.\d{1,3}){3}"), "ip")
        .when(_is(match, r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(
            _is(match, r"\d(?:[ -]?\d){12,18}"),
            F.when(_luhn_sum(_digits(match), True) % 10 == 0, "card").otherwise("account"),
        )
        .when(_is(match, r"\+?[\d(][\d ().-]+"), "phone")
        .when(_is(match, plain), "secret")
    )


def _gender(match: Column) -> Column:
    return (
        F.when(_is(match, rf"(?:{'|'.join(FEMALE_TITLES)})\b.*"), "f")
        .when(_is(match, rf"(?:{'|'.join(MALE_TITLES)})\b.*"), "m")
        .otherwise("n")
    )


def _name_parts(match: Column) -> tuple[Column, Column]:
    """Titles with the blank behind them, and what follows: given names, initials (``J.``)
    and particles, the family name last."""
    title = F.regexp_extract(match, rf"^((?:(?:{_TITLES})\.? )+)", 1)
    return title, F.split(F.substr(match, F.length(title) + 1), " ")


def _name_words(match: Column) -> Column:
    """The words of a match that are names wherever they stand; none of other matches."""
    words = F.filter(_name_parts(match)[1], lambda x: x.rlike(r"^\p{Lu}[^.]*$"))
    return F.when(kind_of(match) == "name", words).otherwise(F.array().cast("array<string>"))


def _with_names(names: Column) -> Column:
    """The pattern of a text that has these names: its entities, and the names by themselves."""
    longest = F.reverse(F.array_sort(F.transform(names, lambda x: F.struct(F.length(x), x.alias("x")))))
    return F.concat(
        F.lit(PATTERN + r"|(?<![\p{L}\p{M}\p{N}])(?:"),
        F.array_join(F.transform(longest, lambda x: x["x"]), "|"),
        F.lit(r")(?![\p{L}\p{M}\p{N}])"),
    )


def _entity(kind, value) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), value.alias("value"))


def entities_of(match: Column) -> Column:
    """The entities of a match, as an array of (kind, value)."""
    kind = kind_of(match)
    parts = _name_parts(match)[1]
    name = F.filter(
        F.transform(
            parts,
            lambda x, i: _entity(
                F.when(i == F.size(parts) - 1, "family").otherwise(
                    F.concat(F.lit("given_"), _gender(match))
                ),
                x,
            ),
        ),
        lambda e: e["value"].rlike(r"^\p{Lu}"),
    )
    value = F.when(kind == "email", F.lower(match)).otherwise(match)
    return (
        F.when(kind == "name", name)
        .when(kind.isNotNull(), F.array(_entity(kind, value)))
        .otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    )


# -- surrogates -----------------------------------------------------------------------


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that the key, the entity and the attempt decide."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), value), 512)


def _number(stream: Column, place: Column, below: int) -> Column:
    """A number from the stream for a place."""
    begin = (F.pmod(place * 3, F.lit(120)) + 1).cast("int")
    drawn = F.conv(F.substr(stream, begin, F.lit(6)), 16, 10).cast("long")
    return F.pmod(drawn + place, F.lit(below)).cast("int")


def _pick(alphabet: str, stream: Column, place: Column) -> Column:
    return F.substr(F.lit(alphabet), _number(stream, place, len(alphabet)) + 1, F.lit(1))


_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"
_ACCENTS, _GREEK = "àâäçèéêëîïñóôöùûü", "αβγδεζηθικλμνξοπρστυφχψω"


def _scrambled(value: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """Each digit and letter by one of its kind and case, the rest as it is."""

    def one(letter: Column, place: Column) -> Column:
        small = F.lower(letter)
        script = (
            F.when(small.rlike("[a-z]"), _pick(_LATIN, stream, place))
            .when(small.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, stream, place))
            .when(small.rlike(r"\p{IsGreek}"), _pick(_GREEK, stream, place))
            .otherwise(_pick(_ACCENTS, stream, place))
        )
        if hexadecimal is not None:
            script = F.when(hexadecimal, _pick("abcdef", stream, place)).otherwise(script)
        cased = F.when(letter == small, script).otherwise(F.upper(script))
        return (
            F.when(letter.rlike(r"\d"), _pick("0123456789", stream, place))
            .when(letter.rlike(r"\p{L}"), cased)
            .otherwise(letter)
        )

    letters = F.filter(F.split(value, ""), lambda x: x != "")
    return F.array_join(F.transform(letters, one), "")


_ONSETS = ("B", "D", "F", "G", "H", "K", "L", "M", "N", "P", "R", "S", "T", "V", "W", "Z")
_MIDDLES = ("al", "an", "ar", "el", "en", "er", "il", "in", "ol", "on", "or", "ul", "un", "ur")
_ENDINGS = {
    "family": ("berg", "dale", "field", "ford", "man", "mont", "sen", "son", "stein", "ton"),
    "given_m": ("bert", "do", "fred", "go", "mund", "rick", "to", "win"),
    "given_f": ("bella", "da", "gard", "lina", "na", "ria", "tina", "wina"),
    "given_n": ("bin", "chi", "ky", "ley", "ly", "ry", "sy", "vy"),
}
_CYRILLIC_PARTS = {
    "onset": ("Б", "В", "Г", "Д", "З", "К", "Л", "М", "Н", "П", "Р", "С", "Т"),
    "middle": ("ал", "ан", "ар", "ел", "ен", "ер", "ил", "ин", "ол", "он", "ор"),
    "family": ("енко", "ских", "чук", "ян"),
    "given_m": ("ан", "ей", "ий", "ор"),
    "given_f": ("ана", "ея", "ина", "ия"),
    "given_n": ("а", "я", "ша", "ня"),
}


def _choice(values: tuple[str, ...], stream: Column, place: int) -> Column:
    options = F.array(*map(F.lit, values))
    return F.element_at(options, _number(stream, F.lit(place), len(values)) + 1)


def _name(kind: str, value: Column, stream: Column, attempt: Column) -> Column:
    """Onset, middles and an ending of the kind, in the script of the value. Attempts add middles."""

    def built(onsets, middles, endings) -> Column:
        more = F.when(attempt >= WIDER, _choice(middles, stream, 3)).otherwise("")
        most = F.when(attempt >= 2 * WIDER, _choice(middles, stream, 4)).otherwise("")
        first, second = _choice(middles, stream, 1), _choice(middles, stream, 2)
        short = F.length(value) < 6
        middle = F.concat(first, F.when(short, "").otherwise(second), more, most)
        return F.concat(_choice(onsets, stream, 0), middle, _choice(endings, stream, 5))

    parts = _CYRILLIC_PARTS
    return F.when(
        value.rlike(r"\p{IsCyrillic}"), built(parts["onset"], parts["middle"], parts[kind])
    ).otherwise(built(_ONSETS, _MIDDLES, _ENDINGS[kind]))


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """What to write for an entity at an attempt."""
    stream = _stream(key, kind, value, attempt)
    wider = attempt - (WIDER - 1)
    more = F.when(
        wider > 0, F.array_join(
            F.transform(F.sequence(F.lit(1), F.greatest(wider, F.lit(1))),
                        lambda i: _pick(_LATIN, stream, i + 70)), "")
    ).otherwise("")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.split(domain, r"\.")
    inner = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    inner = F.array_join(
        F.transform(inner, lambda x: F.concat(_scrambled(x, F.sha2(F.concat(F.lit(key), x), 512)), F.lit("."))), ""
    )
    top = F.element_at(labels, -1)
    reserved = F.when(top.isin("com", "net", "org"), F.concat(F.lit("example."), top)).otherwise(
        "example"
    )
    email = F.concat(_scrambled(local, stream), more, F.lit("@"), inner, reserved)
    octets = [(_number(stream, F.lit(i), 254) + 1).cast("string") for i in range(4)]
    country = F.regexp_extract(value, r"^(\+\d{1,3})", 1)
    phone = F.concat(country, _scrambled(F.substr(value, F.length(country) + 1), stream))
    shaped = F.concat(F.substr(value, F.lit(1), F.lit(1)), _scrambled(F.substr(value, F.lit(2)), stream))
    body = F.substr(_digits(shaped), F.lit(1), F.length(_digits(shaped)) - 1)
    check = F.pmod(-_luhn_sum(body, False), F.lit(10)).cast("string")
    card = F.concat(F.substr(shaped, F.lit(1), F.length(shaped) - 1), check)
    secret = F.concat(_scrambled(value, stream, value.rlike(r"^[0-9a-fA-F]+$")), more)
    result = (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "phone", phone)
        .when(kind.isin("ssn", "account"), _scrambled(value, stream))
        .when(kind == "card", card)
        .when(kind == "secret", secret)
    )
    for name in _ENDINGS:
        result = result.when(kind == name, _name(name, value, stream, attempt))
    return result


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, value, surrogate)`` for distinct ``entities(kind, value)``, a table.

    One surrogate for each entity, no two alike within a kind, none that is itself a value.
    """
    open_ = stage(
        entities.withColumn("attempt", F.lit(0)).withColumn(
            "surrogate", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))
        ),
        "surrogates",
    )
    accepted = None
    for attempt in range(1, MOST_ATTEMPTS + 1):
        first = open_.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        fresh = first.join(
            entities.select("kind", F.col("value").alias("surrogate")),
            ["kind", "surrogate"], "left_anti",
        )
        if accepted is not None:
            fresh = fresh.join(accepted, ["kind", "surrogate"], "left_anti")
        fresh = stage(fresh.select("kind", "value", "surrogate"), "surrogates")
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
        left = open_.join(fresh.select("kind", "value"), ["kind", "value"], "left_anti")
        open_ = stage(
            left.withColumn("attempt", F.lit(attempt)).withColumn(
                "surrogate", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))
            ),
            "surrogates",
        )
        if open_.isEmpty():
            return accepted
    raise ValueError("A format has too few surrogates for its entities")


def replace_entities(
    docs: DataFrame,
    key: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    count_column: str | None = None,
) -> DataFrame:
    """``docs`` with surrogates in the text, and the number of replaced places if asked for.

    Rows without entities pass as they are, null and empty texts too, and are not shuffled.
    Repeated rows and ties are replaced alike. All columns are kept; an empty table gives an
    empty result. Other columns' names do not matter.
    """
    found_name, map_name = free_name(docs, "_found"), free_name(docs, "_map")
    names_name, places_name = free_name(docs, "_names"), free_name(docs, "_places")
    hash_name, total = free_name(docs, "_hash"), count_column or free_name(docs, "_total")
    text = F.col(text_column)
    # Evaluated from left to right: only hinted texts are searched for entities.
    has = F.coalesce(text.rlike(HINT), F.lit(False)) & (F.size(_all_of(text)) > 0)
    plain = docs.where(~has).withColumn(total, F.lit(0).cast("bigint"))
    touched = stage(
        docs.where(has)
        .withColumn(found_name, _all_of(text))
        .withColumn(
            names_name, F.array_distinct(F.flatten(F.transform(F.col(found_name), _name_words)))
        )
        .withColumn(
            places_name,
            F.when(
                F.size(names_name) > 0,
                F.regexp_extract_all(text, _with_names(F.col(names_name)), F.lit(0)),
            ).otherwise(F.col(found_name)),
        )
        .withColumn(hash_name, F.xxhash64(text_column)),
        "touched",
    )
    each = touched.select(
        F.col(id_column).alias("_id"), F.col(hash_name).alias("_hash"),
        F.explode(F.array_distinct(found_name)).alias("match"),
    ).select("_id", "_hash", F.explode(entities_of(F.col("match"))).alias("e")).select(
        "_id", "_hash", "e.kind", "e.value"
    )
    entities = stage(each.select("kind", "value").distinct(), "entities")
    table = surrogate_table(entities, key)
    pair = F.struct(F.concat_ws("\x1f", "kind", "value"), F.col("surrogate"))
    maps = (
        each.distinct()
        .join(table, ["kind", "value"])
        .groupBy("_id", "_hash")
        # as large as the entities of one text
        .agg(F.map_from_entries(F.collect_list(pair)).alias("_map"))
        .select(F.col("_id"), F.col("_hash").alias("_h"), F.col("_map").alias(map_name))
    )
    joined = touched.join(
        maps,
        F.col(id_column).eqNullSafe(F.col("_id")) & (F.col(hash_name) == F.col("_h")),
        "left",
    ).drop("_id", "_h")

    def written(match: Column) -> Column:
        def known(kind, value) -> Column:
            kind = F.lit(kind) if isinstance(kind, str) else kind
            return F.element_at(F.col(map_name), F.concat_ws("\x1f", kind, value))

        kind = kind_of(match)
        title, names = _name_parts(match)
        given_kind = F.concat(F.lit("given_"), _gender(match))

        def named(part: Column, place: Column) -> Column:
            new = F.when(place == F.size(names) - 1, known("family", part)).otherwise(
                known(given_kind, part)
            )
            initial = F.regexp_replace(part, r"\p{Lu}", F.substr(new, F.lit(1), F.lit(1)))
            return (
                F.when(~part.rlike(r"^\p{Lu}"), part).when(part.endswith("."), initial)
                .otherwise(new)
            )

        name = F.concat(title, F.array_join(F.transform(names, named), " "))
        alone = F.coalesce(*(known(kind, match) for kind in _NAME_KINDS))
        email = known("email", F.lower(match))
        email = F.when(match == F.upper(match), F.upper(email)).otherwise(email)
        return (
            F.when(F.array_contains(names_name, match), alone)
            .when(kind == "name", name).when(kind == "email", email)
            .when(kind.isNotNull(), known(kind, match)).otherwise(match)
        )

    pieces = F.when(
        F.size(names_name) > 0,
        F.split(F.col(text_column), _with_names(F.col(names_name)), F.lit(-1)),
    ).otherwise(F.split(F.col(text_column), PATTERN, -1))
    parts = F.transform(
        F.arrays_zip(pieces.alias("a"), F.transform(F.col(places_name), written).alias("b")),
        lambda pair: F.concat(pair["a"], F.coalesce(pair["b"], F.lit(""))),
    )
    replaced = joined.withColumn(
        total,
        F.size(
            F.filter(
                F.col(places_name),
                lambda m: F.array_contains(names_name, m) | kind_of(m).isNotNull(),
            )
        ).cast("bigint"),
    ).withColumn(text_column, F.array_join(parts, ""))
    result = plain.unionByName(replaced.select(*plain.columns))
    return result if count_column else result.drop(total)
