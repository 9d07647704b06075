"""PII surrogates; DataFrame functions only.

Every text is searched once for e-mail addresses, IBANs, social security numbers,
card numbers, IP addresses, phone numbers and titled names.  Each distinct
entity of the corpus gets one surrogate, made from a keyed hash of the entity,
so every mention of it anywhere is replaced alike (coreference).  Surnames are
entities of their own, assigned first: a surname has one surrogate with any title
or given name, and no two surnames have the same.  Surrogates keep the
type, the format (digits for digits, letters for letters of the same script and
case, separators as they are, valid check digits of cards and IBANs where there
were, country code and top-level domain) and, for titled names, the gender of the
title.

Surrogates must be distinct from one another and from every entity found.
Where two entities meet, or a surrogate is an entity, all but the first of them
draw again under the next number, until none meets another.  Draws of a given name
take more and more of the list, hyphenated; where any other format has too little
room (fewer values than entities, or nearly), digits behind the surrogate make it.

Defined results: a null or empty text has no entities and stays empty; repeated
rows are rows each; overlapping candidates are taken leftmost, then in the order
of ``KINDS``; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import shuffle_partitions
from moodspark.session import reliable_checkpoint, scratch_path

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Titles, fixed values: gender, then the titles of that gender.
TITLES = {
    "male": ("Mr", "Herr", "Señor", "Monsieur", "г-н"),
    "female": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "г-жа"),
}
TITLE = "(?:" + "|".join(t for g in TITLES.values() for t in sorted(g, key=len, reverse=True)) + r")\.?"
WORD = r"\p{Lu}[\p{L}'-]*\p{Ll}"
#: kind: pattern.  Each starts at a boundary, so a long run of one class of
#: characters is tried once and not from each of its characters.
KINDS = {
    # a domain has at most 127 labels of at most 63 signs; no group repeats without bound,
    # since Java's engine recurses with each turn of one
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,126}\p{L}{2,63}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "phone": r"(?<![\p{L}\p{N}+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){TITLE} {WORD}(?: {WORD})?(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Given names of surrogates, fixed values, by script and gender.
GIVEN = {
    ("latin", "male"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul".split(),
    ("latin", "female"): "Alma Berta Clara Dora Emma Frida Greta Helen Irma Julia Karin Laura Maria Nora Olga Paula".split(),
    ("cyrillic", "male"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Никита Олег Павел Роман Сергей Тимур Юрий".split(),
    ("cyrillic", "female"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Полина Софья Юлия".split(),
}
#: Letters that stand in for letters of their script: a letter's class, then its stand-ins.
ALPHABETS = {
    r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsHan}": "安白成东方高海江林明南平清山天文小新云中",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
#: After so many draws that met others (a format with too little room) a surrogate
#: gets digits behind it, one more with each draw.
PLAIN_DRAWS = 16
#: Entities with more mentions than this are so few that they may be broadcast.
HOT_MENTIONS = 1_000_000


def hits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole entity, in the order of the search."""
    found = F.lit("name")
    for kind in reversed([*KINDS][:-1]):
        found = F.when(entity.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(found)
    return found


def keyed(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits that only the key's holder can make (hash of key and hash)."""
    inner = F.sha2(F.concat_ws("\u001f", F.lit(key), *parts), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def number(hexes: Column, at: Column | int, below: int) -> Column:
    """A number under ``below`` from seven of the hexadecimal digits."""
    start = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substring(hexes, start, F.lit(7)), 16, 10).cast("long") % F.lit(below)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shaped(value: Column, key: str, *parts: Column) -> Column:
    """``value`` with each digit and letter replaced by one of its class, by the
    key; a block of eight characters draws from a hash of its own, made of a hash of
    the parts (so that a long value takes time in proportion to its length)."""

    def stand_in(seed: Column, c: Column, i: Column) -> Column:
        h = F.sha2(F.concat(seed, F.floor(i / 8).cast("string")), 256)
        at = ((i % 8) * 7 + 1).cast("int")
        out = F.when(c.rlike("[0-9]"), number(h, at, 10).cast("string"))
        for cls, letters in ALPHABETS.items():
            out = out.when(c.rlike(cls), F.substring(F.lit(letters), (number(h, at, len(letters)) + 1).cast("int"), F.lit(1)))
        return out.otherwise(c)

    return once(keyed(key, *parts), lambda seed: F.array_join(F.transform(F.split(value, ""), lambda c, i: stand_in(seed, c, i)), ""))


def remainder_97(iban: Column) -> Column:
    """An IBAN's check remainder: its first four signs last, letters as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(
        (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.coalesce(F.when(c != "", value(c)), F.lit(0))) % 97))


def _iban(entity: Column, key: str, seed: tuple) -> Column:
    """Drawn but for the country; the two check digits made right where they were."""
    drawn = F.concat(F.substring(entity, 1, 2), shaped(F.substring(entity, F.lit(3), F.length(entity)), key, *seed))

    def right(d: Column) -> Column:
        bare = F.concat(F.substring(d, 1, 2), F.lit("00"), F.substring(d, F.lit(5), F.length(d)))
        return F.concat(F.substring(d, 1, 2), F.lpad((98 - remainder_97(bare)).cast("string"), 2, "0"), F.substring(d, F.lit(5), F.length(d)))

    return F.when(remainder_97(entity) == 1, once(drawn, right)).otherwise(drawn)


def surrogate(kind: Column, entity: Column, draw: Column, key: str) -> Column:
    """The surrogate of an entity (a surname too, of kind ``family``) under the number of the draw."""
    seed = (kind, draw.cast("string"), entity)
    h = keyed(key, *seed)
    octets = [(number(h, 1 + 7 * i, 254) + 1).cast("string") for i in range(4)]
    digits = shaped(entity, key, *seed)

    def checked(d: Column) -> Column:
        """All digits but the last are drawn; the last makes the check sum right."""
        plain = F.regexp_replace(d, "[ -]", "")
        last = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda x: F.call_function(
            "luhn_check", F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), x.cast("string")))), 1)
        return F.concat(F.substring(d, F.lit(1), F.length(d) - 1), last.cast("string"))

    card = F.when(F.call_function("luhn_check", F.regexp_replace(entity, "[ -]", "")), once(digits, checked)).otherwise(digits)
    country = F.regexp_extract(entity, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(entity, F.length(country) + 1, F.length(entity))
    top = F.regexp_extract(entity, r"\.\p{L}{2,}$", 0)
    return (F.when(kind == "email", F.concat(
                shaped(F.substring(entity, F.lit(1), F.length(entity) - F.length(top)), key, *seed), top))
            .when(kind == "iban", _iban(entity, key, seed))
            .when(kind == "card", card)
            .when(kind == "ip", F.concat_ws(".", *octets))
            .when(kind == "phone", F.concat(country, shaped(rest, key, *seed)))
            .otherwise(digits))


def given_name(title: Column, family: Column, given: Column, draw: Column, key: str) -> Column:
    """A given name of the title's gender and the surname's script; a later draw may
    join more names, so that there is always room."""
    script = F.when(family.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    female = title.rlike(r"^(?:" + "|".join(TITLES["female"]) + r")\.?$")
    gender = F.when(female, F.lit("female")).otherwise(F.lit("male"))
    h = keyed(key, F.lit("given"), gender, draw.cast("string"), given)
    names = F.array(*[F.lit(n) for n in GIVEN["latin", "male"]])
    for (s, g), of in GIVEN.items():
        names = F.when((script == s) & (gender == g), F.array(*map(F.lit, of))).otherwise(names)
    parts = F.sequence(F.lit(0), F.floor(draw / F.lit(8)).cast("int"))
    return F.array_join(F.transform(parts, lambda i: F.element_at(names, (number(F.sha2(F.concat(h, i.cast("string")), 256), 1, 16) + 1)
                                                                  .cast("int"))), "-")


def _settled(drawn: DataFrame, redraw) -> DataFrame:
    """``drawn`` (``entity, draw, surrogate`` and more) with ``redraw(next draw)`` until no
    surrogate is there twice or is an entity.

    Each draw is checked over the corpus by two shuffles of short rows.  The
    first entity of a surrogate keeps it; the others draw again.
    """
    drawn = reliable_checkpoint(drawn)
    while True:
        # who has drawn less often comes first, so a kept surrogate stays kept
        order = F.row_number().over(Window.partitionBy("surrogate").orderBy("draw", "entity"))
        taken = drawn.select(F.col("entity").alias("surrogate"), F.lit(True).alias("taken"))
        checked = reliable_checkpoint(drawn.withColumn("nth", order).join(taken, "surrogate", "left"))
        again = (F.col("nth") > 1) | F.col("taken").isNotNull()
        if checked.where(again).isEmpty():
            return checked.drop("nth", "taken")
        following = (F.col("draw") + 1).cast("int")
        drawn = reliable_checkpoint(checked.withColumns({
            "surrogate": F.when(again, redraw(following)).otherwise(F.col("surrogate")),
            "draw": F.when(again, following).otherwise(F.col("draw"))}).drop("nth", "taken"))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``entity, kind, surrogate`` for distinct ``entity``s (``kind`` is told if it isn't
    there): no surrogate twice, none an entity."""
    if "kind" not in entities.columns:
        entities = entities.withColumn("kind", kind_of(F.col("entity")))

    def drawn(draw: Column) -> Column:
        more = F.greatest(draw - F.lit(PLAIN_DRAWS), F.lit(0))
        digits = F.translate(F.substring(keyed(key, F.lit("more"), F.col("entity"), draw.cast("string")), F.lit(1), more), "abcdef", "012345")
        return F.concat(surrogate(F.col("kind"), F.col("entity"), draw, key), digits)

    # the work is in the draws, not in the bytes: as many tasks as the session's shuffles have
    dealt = entities.select("entity", "kind", F.lit(0).alias("draw")).repartition(shuffle_partitions(entities.sparkSession), "entity")
    return _settled(dealt.withColumn("surrogate", drawn(F.col("draw"))), drawn).select("entity", "kind", "surrogate")


def assign_names(names: DataFrame, key: str) -> DataFrame:
    """``entity, kind, surrogate`` for distinct titled names: surnames first, then the names."""
    word = F.split("entity", " ")
    parts = names.select("entity", F.element_at(word, 1).alias("title"), F.element_at(word, -1).alias("family"),
                         F.when(F.size(word) > 2, F.element_at(word, 2)).alias("given"))
    families = assign(parts.select(F.col("family").alias("entity")).distinct().withColumn("kind", F.lit("family")), key)
    parts = parts.join(families.select(F.col("entity").alias("family"), F.col("surrogate").alias("stand_in")), "family")

    def drawn(draw: Column) -> Column:
        given = F.when(F.col("given").isNotNull(), given_name(F.col("title"), F.col("family"), F.col("given"), draw, key))
        # without a given name nothing is drawn: its surname is its own, unless that makes another entity
        other = F.when(F.col("given").isNull() & (draw > 0), shaped(F.col("stand_in"), key, F.lit("other"), draw.cast("string"), F.col("family")))
        return F.concat_ws(" ", F.col("title"), given, F.coalesce(other, F.col("stand_in")))

    dealt = parts.withColumn("draw", F.lit(0))
    return _settled(dealt.withColumn("surrogate", drawn(F.col("draw"))), drawn).select("entity", F.lit("name").alias("kind"), "surrogate")


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the number of entities by kind, ``n_entities`` and the ``text`` with surrogates."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # searched once: every text is kept, cut at its entities (the few texts that have any)
    path = scratch_path(spark, "pii")
    (docs.withColumn("hits", hits(F.col("text")))
     .select("doc_id", "hits", F.when(F.size("hits") > 0, F.split("text", ANY, -1)).otherwise(F.array("text")).alias("gaps"))
     .withColumn("row", F.monotonically_increasing_id()).write.parquet(path))
    held = spark.read.parquet(path)
    mentions = held.where(F.size("hits") > 0).select("row", F.posexplode("hits").alias("i", "entity"))
    entities = reliable_checkpoint(mentions.groupBy("entity").agg(F.count("*").alias("n")).withColumn("kind", kind_of(F.col("entity"))))
    given = reliable_checkpoint(
        assign(entities.where("kind <> 'name'").select("entity", "kind"), key)
        .unionByName(assign_names(entities.where("kind = 'name'"), key)).join(entities.select("entity", "n"), "entity"))
    hot = F.broadcast(given.where(F.col("n") > HOT_MENTIONS).drop("n"))  # at most mentions / HOT_MENTIONS
    said = (mentions.join(hot, "entity").unionByName(
        mentions.join(hot, "entity", "left_anti").join(given.where(F.col("n") <= HOT_MENTIONS).drop("n"), "entity")))
    by_row = (said.groupBy("row")
              .agg(F.sort_array(F.collect_list(F.struct("i", "surrogate", "kind"))).alias("said")))
    whole = held.where(F.size("hits") > 0).select("row", "doc_id", "gaps").join(by_row, "row")
    text = F.array_join(F.transform(F.arrays_zip("gaps", "said"), lambda x: F.concat(
        x["gaps"], F.coalesce(x["said"]["surrogate"], F.lit("")))), "")

    def count(kind: str) -> Column:
        return F.size(F.filter("said", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    replaced = whole.select("doc_id", *[count(k) for k in KINDS], F.size("said").cast("long").alias("n_entities"),
                            text.alias("text"))
    none = F.lit(0).cast("long")
    untouched = held.where(F.size("hits") == 0).select("doc_id", *[none.alias(f"n_{k}") for k in KINDS], none.alias("n_entities"),
                                                       F.element_at("gaps", 1).alias("text"))
    return replaced.unionByName(untouched)
