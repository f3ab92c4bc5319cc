"""Personal data replaced by keyed surrogates; DataFrame functions only.

Entities are mail addresses, IPv4 addresses, phone, card and social numbers,
secrets and titled names.  Phone numbers are those with a leading + and the
national forms (826) 555-4081, 826-555-4081 and 826.555.4081; other national
forms, and names without one of the titles, are left as they are.

An entity is made of *units*: a mail address of its mailbox and its domain, a
name of given name and surname, a number of its digits, a secret of itself.
Each unit has one surrogate, drawn from a keyed hash of the unit in lower case
and without punctuation, so it has the same one wherever it stands: a person
with another title, a family, a domain and a number written in another form
stay what they are.  Rendering keeps the entity's punctuation, the case of its
letters and a name's title.  A letter is drawn from its own alphabet.  Card
numbers keep the first digit and end in a valid check digit.  The given names
of ``GIVEN`` are permuted within their script and gender; other given names
become invented ones of their script that show no gender, and a name without a
given name gets none.

Distinct units must have distinct surrogates, and but for permuted given names
no surrogate may be a unit that stands in the corpus.  All distinct units are
checked for that; those in conflict draw again with the number of draws hashed
in, until none is left.  From draw ``LONGER`` on each draw adds a character, so
that no form's space is ever exhausted and the draws end.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._spark import cut, free_names, row_key, table

# Titles, given names by script and gender, and the syllables of invented names.
TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Dr", "Prof"]
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Arthur Bruno Carl Daniel Edgar Felix Georg Henri Hugo Ivan Jonas Julian Leon Lukas Martin Max Oscar Paul Robert Simon Victor".split(),
    ("latin", "f"): "Ada Alice Anna Bella Clara Diana Elena Emma Eva Flora Greta Helena Ida Irene Julia Laura Lena Maria Marta Nora Olga Rosa Sara Vera".split(),
    ("cyrillic", "m"): "Алексей Андрей Антон Борис Виктор Глеб Денис Егор Иван Илья Кирилл Лев Максим Матвей Никита Олег Павел Пётр Роман Семён Степан Тимур Фёдор Юрий".split(),
    ("cyrillic", "f"): "Алла Анна Белла Вера Галина Дарья Елена Жанна Зоя Инна Ирина Кира Лидия Майя Мария Нина Ольга Полина Раиса Софья Тамара Ульяна Фаина Юлия".split(),
}
SYLLABLES = {
    "latin": "bar bel dor fen gal hal kor lan mar nel or pen ros sel tor ven".split(),
    "cyrillic": "бар бел дор фен гал хал кор лан мар нел ор пен рос сел тор вен".split(),
}
#: Letters by script; those of other scripts are drawn from the first.
ALPHABETS = [
    ("Latin", "abcdefghijklmnopqrstuvwxyz"),
    ("Cyrillic", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    ("Greek", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("Hebrew", "אבגדהוזחטיכלמנסעפצקרשת"),
    ("Arabic", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    ("Han", "一二三四五六七八九十木水火土金山川田人天"),
]
NAME_SYLLABLES, LONGER = 5, 8

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NAMED = "|".join(TITLES)
_BOX = r"[\p{L}0-9._%+-]"
_HOST = r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: A mailbox begins where its run of letters does, or where the entity before it ends; each run is read once.
_EMAIL = rf"(?:(?<!{_BOX}){_BOX}++|\G{_BOX}{{1,64}}+){_HOST}"
_IPV4 = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"
_CARD = r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b"
_SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_NATIONAL = r"(?:\([0-9]{3}\) ?|\b[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}\b"
_ABROAD = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})"
_BESIDE = rf"{_IPV4}|{_SSN}|{_NATIONAL}|\b{_BOX}{{1,64}}+{_HOST}"
_MORE = "(?:[ .-]?(?!{})[0-9]{{2,4}})"
#: The digits of a phone number end where another entity begins.  Its own last groups may look like the start of a card
#: (second form), and a number that has no other reading runs on (third form).
_PHONE = "|".join(
    [
        rf"{_ABROAD}{_MORE.format(f'{_BESIDE}|{_CARD}')}{{2,3}}\b",
        rf"{_ABROAD}{_MORE.format(_BESIDE)}{{2}}{_MORE.format(f'{_BESIDE}|{_CARD}')}?\b",
        rf"{_ABROAD}(?:[ .-]?[0-9]{{2,4}}){{2,3}}\b",
        _NATIONAL,
    ]
)
#: Each kind's pattern, for Java.  The first that fits at a place wins.
PATTERNS = [
    ("email", _EMAIL),
    ("ipv4", _IPV4),
    ("phone", _PHONE),
    ("card", _CARD),
    ("ssn", _SSN),
    ("key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("secret", r"\b[0-9a-fA-F]{32,64}\b"),
    ("name", rf"\b(?:{_NAMED})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Texts without this hold no entity.
_HINT = rf"[0-9@]|AKIA|[a-fA-F]{{32}}|(?:{_NAMED})\.? \p{{Lu}}"


def kind_of(value: Column) -> Column:
    """The kind of a string that ``PATTERN`` found."""
    return reduce(lambda rest, p: F.when(value.rlike(f"^(?:{p[1]})$"), p[0]).otherwise(rest), reversed(PATTERNS), F.lit(None).cast("string"))


def _let(x: Column, then) -> Column:
    """``then(x)`` with x computed once, however often it is used."""
    return F.get(F.transform(F.array(x), then), 0)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _name_parts(value: Column) -> tuple[Column, Column, Column]:
    """Title, given name (null for none) and surname."""
    parts = F.split(value, " ")
    return parts[0], F.when(F.size(parts) > 2, parts[1]), F.element_at(parts, -1)


def units(value: Column, kind: Column) -> Column:
    """Array of struct(kind, core): the units of an entity that have surrogates of their own."""

    def of(name: str, core: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), core.alias("core"))

    box, domain = (F.lower(F.substring_index(value, "@", n)) for n in (1, -1))
    _, given, family = _name_parts(value)
    lone = F.array(of("family", F.lower(family)))
    return (
        F.when(kind == "email", F.array(of("mailbox", box), of("domain", domain)))
        .when((kind == "name") & given.isNull(), lone)
        .when(kind == "name", F.array(of("given", F.lower(given)), of("family", F.lower(family))))
        .otherwise(F.array(F.struct(kind.alias("kind"), F.when(kind == "ipv4", value).when(kind == "key", value).when(kind == "secret", F.lower(value)).otherwise(_digits(value)).alias("core"))))
    )


def _stream(key: Column, kind: Column, core: Column, draw: Column) -> Column:
    """128 hex digits of keyed hash."""
    return _let(F.sha2(F.concat_ws("|", key, kind, draw.cast("string"), core), 256), lambda inner: F.concat(F.sha2(F.concat(key, inner), 256), F.sha2(F.concat(inner, key), 256)))


def _number(stream: Column, at: Column) -> Column:
    """Two hex digits of the stream as a number; further on the stream is hashed again."""
    hex_ = F.when(at < 64, stream).otherwise(F.sha2(F.concat(stream, F.floor(at / 32).cast("string")), 256))
    place = F.when(at < 64, at * 2 + 1).otherwise((at % 32) * 2 + 1)
    return F.conv(F.substr(hex_, place.cast("int"), F.lit(2)), 16, 10).cast("int")


def _of(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _alike(core: Column, stream: Column, letters: str | None = None) -> Column:
    """``core`` with each digit and letter drawn anew, letters from their own alphabet or from ``letters``."""

    def drawn(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        if letters:
            return F.when(c.rlike(r"^[\p{L}0-9]$"), _of(letters, n)).otherwise(c)
        own = F.when(c.rlike("^[0-9]$"), "0123456789").when(c.rlike("^[A-Z]$"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        for script, alphabet in ALPHABETS:
            own = own.when(c.rlike(rf"^[\p{{L}}&&\p{{Is{script}}}]$"), alphabet)
        own = own.when(c.rlike(r"^\p{L}$"), ALPHABETS[0][1])
        # the alphabet is chosen first, so the tree holds one draw and not one for each alphabet
        return _let(own, lambda a: F.coalesce(F.substr(a, n % F.length(a) + 1, F.lit(1)), c))

    return F.array_join(F.transform(F.split(core, ""), drawn), "")


def _check_digit(digits: Column) -> Column:
    """``digits`` with the last one made the check digit of the others."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda s, i: s + part(i))
    return F.concat(F.substr(digits, F.lit(1), n - 1), ((10 - total % 10) % 10).cast("string"))


def permuted(key: str) -> dict[str, str]:
    """The given names, each with another of its script and gender; a bijection that the key decides."""
    out = {}
    for names in GIVEN.values():
        round_ = sorted(names, key=lambda x: hashlib.sha256(f"{key}|{x}".encode()).digest())
        out |= {a.lower(): b for a, b in zip(round_, round_[1:] + round_[:1])}
    return out


def _invented(core: Column, stream: Column, draw: Column) -> Column:
    """A name of syllables in the script of ``core``; from ``LONGER`` draws on a longer one."""

    def of(script: str) -> Column:
        several = F.sequence(F.lit(0), F.lit(NAME_SYLLABLES - 1) + F.greatest(draw - LONGER, F.lit(0)))
        names = F.array(*map(F.lit, SYLLABLES[script]))
        return F.initcap(F.array_join(F.transform(several, lambda i: F.element_at(names, _number(stream, i) % len(SYLLABLES[script]) + 1)), ""))

    return F.when(core.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def draw_unit(kind: Column, core: Column, draw: Column, key: Column) -> Column:
    """The surrogate of a unit on its ``draw``-th draw."""

    def drawn(s: Column) -> Column:
        top = F.substring_index(core, ".", -1)
        host = F.substr(core, F.lit(1), F.length(core) - F.length(top) - 1)
        extra = F.when(draw >= LONGER, F.array_join(F.transform(F.sequence(F.lit(0), draw - LONGER), lambda i: _of("0123456789", _number(s, i + 40))), "")).otherwise("")
        ipv4 = F.concat_ws(".", *[(_number(s, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
        code = F.when(F.length(core) > 10, F.left(core, F.length(core) - 10)).otherwise("")
        kept = F.when(kind == "card", F.left(core, F.lit(1))).when(kind == "phone", code).when(kind == "key", F.lit("AKIA")).otherwise("")
        body = F.when(kind == "domain", host).when(~kind.isin("given", "family", "ipv4", "secret"), F.substr(core, F.length(kept) + 1))

        def put(new: Column) -> Column:
            return (
                F.when(kind.isin("given", "family"), _invented(core, s, draw))
                .when(kind == "domain", F.concat(new, extra, F.lit("."), top))
                .when(kind == "ipv4", F.concat(ipv4, extra))
                .when(kind == "card", _check_digit(F.concat(kept, new, extra)))
                .when(kind == "secret", F.concat(_alike(core, s, "0123456789abcdef"), extra))
                .otherwise(F.concat(kept, new, extra))
            )

        # one tree draws the characters of all forms but secrets
        return _let(_alike(body, s), put)

    return _let(_stream(key, kind, core, draw), drawn)


def _cased(like: Column, x: Column) -> Column:
    """``x`` with a capital wherever ``like`` has one."""
    each = F.array_join(F.transform(F.split(x, ""), lambda c, i: F.when(F.substr(like, i + 1, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    return F.when(like == F.lower(like), x).when(like == F.upper(like), F.upper(x)).otherwise(each)


def _in_format(like: Column, digits: Column) -> Column:
    """``like`` with its digits replaced by ``digits`` in turn; what is left over follows."""
    nth = lambda i: F.length(_digits(F.substr(like, F.lit(1), i + 1)))
    filled = F.transform(F.split(like, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(digits, nth(i), F.lit(1))).otherwise(c))
    return F.concat(F.array_join(filled, ""), F.substr(digits, F.length(_digits(like)) + 1))


def rendered(value: Column, kind: Column, new: Column) -> Column:
    """The entity with the surrogates ``new`` (array) of its units, in the entity's own format."""
    title, given, family = _name_parts(value)
    word = lambda like, x: F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(x)).otherwise(x)
    last = F.element_at(new, -1)
    return (
        F.when(kind == "email", F.concat(_cased(F.substring_index(value, "@", 1), new[0]), F.lit("@"), last))
        .when((kind == "name") & given.isNull(), F.concat_ws(" ", title, word(family, last)))
        .when(kind == "name", F.concat_ws(" ", title, word(given, new[0]), word(family, last)))
        .when(kind == "secret", _cased(value, last))
        .when(kind.isin("ipv4", "key"), last)
        .otherwise(_in_format(value, last))
    )


def entities(text: Column) -> Column:
    """The entities of a text in order; none for a null text."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))


def _draws(found: DataFrame, key: Column, draw_once) -> DataFrame | None:
    """kind, core and draw of the units (kind, core) whose first draw is in conflict; None for none."""
    again, held = None, found.withColumn("draw", F.lit(0))
    originals = found.select("kind", F.col("core").alias("s"), F.lit(None).cast("string").alias("core"), F.lit(None).cast("int").alias("draw"), F.lit(0).alias("mine"))
    while True:
        drawn = held.select("kind", draw_once(F.col("kind"), F.col("core"), F.col("draw"), key).alias("x"), "core", "draw", F.lit(1).alias("mine"))
        both = drawn.withColumn("s", F.lower("x")).drop("x").unionByName(originals)
        # originals come first, so any surrogate equal to one is in conflict; of several equal surrogates the first stays
        same = Window.partitionBy("kind", "s").orderBy("mine", "core")
        clash = cut(both.withColumn("turn", F.row_number().over(same)).where("mine = 1 AND turn > 1").select("kind", "core", (F.col("draw") + 1).alias("next")))
        if clash.isEmpty():
            return again
        more = clash if again is None else again.join(clash, ["kind", "core"], "full").select("kind", "core", F.coalesce("next", "draw").alias("next"))
        again = cut(more.withColumnRenamed("next", "draw"))
        held = found.join(again, ["kind", "core"], "left").select("kind", "core", F.coalesce("draw", F.lit(0)).alias("draw"))


#: Texts with units that draw again are joined by broadcast up to so many of them, of so many bytes.
SMALL_ROWS, SMALL_BYTES = 20_000, 8_000_000


def pseudonymise(docs: DataFrame, key: str, draw_once=draw_unit) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the entities of text replaced; all columns kept, plus n_entities.

    Null and empty texts stay as they are with no entities.  Texts of any
    length are read whole, in time that grows with their length.  Rows with
    null or repeated ids are treated like all others; equal units have equal
    surrogates wherever they stand.  An empty table gives no rows.  Where
    ``docs`` has a column n_entities, the new one's name gets an underscore.
    """
    secret, text = F.lit(key), F.col("text")
    names = permuted(key)
    listed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    value = docs.select(F.explode(entities(text)).alias("value")).distinct()
    found = value.select(F.explode(units(F.col("value"), kind_of(F.col("value")))).alias("u")).select("u.kind", "u.core").where(~((F.col("kind") == "given") & F.col("core").isin(list(names))))
    again = _draws(cut(found.distinct()), secret, draw_once)
    spare, keys, k1, k2, drawn = free_names(docs, "found", "gaps", "_k1", "_k2", "drawn")

    def new(v: Column, draw_of) -> Column:
        def of(kind: Column) -> Column:
            surrogates = F.transform(units(v, kind), lambda u: F.coalesce(F.when(u["kind"] == "given", F.element_at(listed, u["core"])), draw_once(u["kind"], u["core"], draw_of(u), secret)))
            return _let(surrogates, lambda s: rendered(v, kind, s))

        return _let(kind_of(v), of)

    def replaced(df: DataFrame, draw_of) -> DataFrame:
        count = free_names(docs, "n_entities")[0]
        pieces = df.withColumns({spare: entities(text)}).withColumn(keys, F.when(F.size(spare) > 0, F.split(text, PATTERN, -1)))
        whole = F.concat(F.array_join(F.transform(spare, lambda v, i: F.concat(F.element_at(keys, i + 1), new(v, draw_of))), ""), F.element_at(keys, -1))
        return pieces.withColumns({"text": F.when(F.size(spare) > 0, whole).otherwise(text), count: F.size(spare)}).select(*docs.columns, count)

    if again is None:
        return replaced(docs, lambda u: F.lit(0))
    # only texts that hold a unit with further draws need their numbers
    keyed = docs.withColumns(dict(zip((k1, k2), row_key("doc_id", "text"))))
    places = keyed.select(k1, k2, F.explode(entities(text)).alias("value")).select(k1, k2, F.explode(units(F.col("value"), kind_of(F.col("value")))).alias("u"))
    numbers = places.select(k1, k2, "u.kind", "u.core").distinct().join(again, ["kind", "core"])
    numbers = cut(numbers.groupBy(k1, k2).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "core"), "draw"))).alias(drawn)))
    n, size = numbers.agg(F.count("*"), F.sum(F.aggregate(F.map_keys(drawn), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 20))).first()
    joined = keyed.join(F.broadcast(numbers) if n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else numbers, [k1, k2], "left")
    return replaced(joined, lambda u: F.coalesce(F.element_at(drawn, F.concat_ws(":", u["kind"], u["core"])), F.lit(0)))


#: The surrogate key of the registered query; a real run passes its own secret.
QUERY_KEY = "surrogates of the registered query"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, QUERY_KEY).select("doc_id", F.col("n_entities").cast("long").alias("n_entities"), "text")
