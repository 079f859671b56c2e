"""Personal data: detected entities get keyed surrogates of the same type, format, script and gender.

An entity is a (type, normal form) pair, the same wherever and however it is written; a person's given name and
surname are entities of their own, so that "Mr John Smith", "Mr Smith" and, in the same text, a bare "John Smith" or
"Smith" get names that belong together. An entity's surrogate comes from a keyed digest, so every mention in every document gets the same one. Candidates that collide with
another entity's surrogate or with any entity that occurs are drawn again until none does. Everything is
DataFrame work; only mentions are shuffled, and only documents that have any are rebuilt.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.shared import fresh, numbered, staged


class Kind(NamedTuple):
    """``shape`` says how mentions are normalised and surrogates rendered: digits, letters, address or person."""

    name: str
    pattern: str
    shape: str


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# fixed values: forms of address with the gender they tell
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Mister", "Г-н", "Господин")
NEUTRAL = ("Dr", "Prof", "Professor", "Доктор", "Профессор")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа")
_NAME = r"\p{Lu}[\p{L}'’-]{1,30}"
# a whole word that may be a person's name, and what a name's genitive adds to it
BARE = r"(?<![\p{L}'’-])\p{Lu}[\p{L}'’-]{1,30}+(?!\p{L})"
_ENDING = r"(?:['’]s|['’-])?$"

# Tried in this order at each place. Every repetition is bounded, or guarded by what may stand before it, so that
# a text of any length is scanned in time proportional to its length.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z])", "address"),
    Kind("ip", rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])", "octets"),
    Kind("ip6", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}:(?:[0-9A-Fa-f]{1,4}:){0,4}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])", "letters"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs](?:-[A-Za-z0-9]{6,40}){2,6}+|sk-[A-Za-z0-9]{20,64}|[0-9a-f]{32,64}+|[0-9A-F]{32,64}+)(?![A-Za-z0-9])", "letters"),
    Kind("card", r"(?<![0-9])(?:[2-6][0-9]{3}(?:[ -]?[0-9]{4}){3}(?:[ -]?[0-9]{3})?|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5}|[2-6][0-9]{12,18})(?![0-9])", "digits"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digits"),
    Kind("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "digits"),
    Kind("phone", r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])", "digits"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "letters"),
    Kind("person", rf"(?<!\p{{L}})(?:{'|'.join((*FEMALE, *MALE, *NEUTRAL))})\.? {_NAME}(?: {_NAME})?", "person"),
)
EVERY = "|".join(f"(?:{k.pattern})" for k in KINDS)

# surrogate names by gender and script; the fixed parts that a keyed number extends when they run out
NAMES = {
    ("m", "Latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
    ("f", "Latin"): "Ada Berta Clara Dora Emma Flora Greta Hanna Ida Julia Klara Lena Maria Nora Olga Paula".split(),
    ("m", "Cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур".split(),
    ("f", "Cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса София".split(),
    ("n", "Latin"): "Alex Charlie Chris Eli Jamie Jessie Kim Luca Mika Nico Noa Robin Sam Sascha Toni Vanja".split(),
    ("n", "Cyrillic"): "Валя Женя Паша Саша Сима Слава Шура".split(),
}
SYLLABLES = {
    "Latin": "bal cor den fal gar hol jen kir lan mer nor pel ros san tor vel".split(),
    "Cyrillic": "бал кор ден фал гар хол жен кир лан мер нор пел рос сан тор вел".split(),
}
# Draws after which the surrogates of a format count as exhausted; each one settles most of what is left while there is room.
MOST_DRAWS = 64


def _shape(kind: Column) -> Column:
    shapes = {k.name: k.shape for k in KINDS}
    return reduce(lambda rest, k: F.when(kind == k, F.lit(shapes[k])).otherwise(rest), shapes, F.lit(None).cast("string"))


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern is the whole mention."""
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{k.pattern})$"), F.lit(k.name)) for k in KINDS])


def _bare_name(mention: Column) -> Column:
    return F.regexp_replace(mention, r"^\S+ ", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum modulo 10; from the right, digits are doubled from the given place on."""
    def worth(c: Column, i: Column) -> Column:
        value = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == doubled, F.when(value > 4, 2 * value - 9).otherwise(2 * value)).otherwise(value)
    values = F.transform(F.split(F.reverse(digits), ""), worth)
    return F.pmod(F.aggregate(values, F.lit(0), lambda total, v: total + F.coalesce(v, F.lit(0))), F.lit(10))


def card_number(mention: Column) -> Column:
    """A card's digits, or null when the check digit is wrong; three digits after 16 can be another number."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    first = F.substring(digits, 1, 16)
    return (
        F.when(_luhn(digits, 1) == 0, digits)
        .when(mention.rlike("[ -][0-9]{3}$") & (F.length(digits) == 19) & (_luhn(first, 1) == 0), first))


def normal_form(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity have in common; null for what is no entity."""
    return (
        F.when(kind == "card", card_number(mention))
        .when(kind.isin("ssn", "phone"), F.regexp_replace(mention, "[^0-9]", ""))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(mention))
        .when(kind == "ip6", F.lower(mention))
        .otherwise(mention))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, _ENDING, "")


def _ending(name: Column) -> Column:
    return F.regexp_extract(name, _ENDING, 0)


def entities_of(kind: Column, mention: Column) -> Column:
    """The entities of a mention, as an array of (kind, normal): two for a person with two names, none for what is no entity."""
    def is_a(titles: tuple[str, ...]) -> Column:
        return mention.rlike(rf"^(?:{'|'.join(titles)})\.? ")
    gender = F.when(is_a(FEMALE), "f").when(is_a(MALE), "m").otherwise("n")
    names, normal = F.split(_bare_name(mention), " "), normal_form(kind, mention)
    given = F.struct(F.lit("given").alias("kind"), F.concat(gender, F.lit(" "), _stem(F.get(names, F.lit(0)))).alias("normal"))
    surname = F.struct(F.lit("surname").alias("kind"), _stem(F.element_at(names, -1)).alias("normal"))
    return (
        F.when((kind == "person") & (F.size(names) > 1), F.array(given, surname)).when(kind == "person", F.array(surname))
        .when(normal.isNotNull(), F.array(F.struct(kind.alias("kind"), normal.alias("normal"))))
        .otherwise(F.array().cast("array<struct<kind:string,normal:string>>")))


def _number(digest: Column, at: Column | int, most: int) -> Column:
    """A number below ``most`` from four hexadecimal digits of a digest."""
    part = F.substring(digest, F.pmod(F.lit(at) * 4 if isinstance(at, int) else at * 4, F.lit(256)).cast("int") + 1, F.lit(4))
    return F.pmod(F.conv(part, 16, 10).cast("int"), F.lit(most))


def _pick(digest: Column, at: Column | int, letters: str) -> Column:
    return F.substring(F.lit(letters), _number(digest, at, len(letters)) + 1, F.lit(1))


def _same_shape(text: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters of the same case and range, anything else as it is."""
    def swapped(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("^[0-9]$"), _pick(digest, i, "0123456789"))
            .when(c.rlike("^[a-f]$"), _pick(digest, i, "abcdef")).when(c.rlike("^[g-z]$"), _pick(digest, i, "ghijklmnopqrstuvwxyz"))
            .when(c.rlike("^[A-Z]$"), _pick(digest, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), swapped), "")


def candidate(kind: Column, normal: Column, key: str, attempt: int) -> Column:
    """The surrogate's normal form on the given attempt; later attempts have more room, where the format allows."""
    seed = F.concat_ws("\x1f", F.lit(key), F.lit(str(attempt)), kind, normal)
    digest = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)])
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    more = F.lower(F.substring(digest, 200, 2 * attempt)) if attempt else F.lit("")
    address = F.concat(_same_shape(local, digest), more, F.lit("@"),
                       F.regexp_replace(domain, r"^.*(\.[^.]+)$", "example$1"))
    octets = F.concat_ws(".", (F.lit(240) + _number(digest, 0, 16)).cast("string"),
                         *[_number(digest, i, 256).cast("string") for i in (1, 2, 3)])
    cyrillic = normal.rlike(r"\p{IsCyrillic}")
    names = []
    for (gender, script), given in NAMES.items():
        syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        def spelled(n: int) -> Column:
            return F.concat(F.lit(""), *[F.get(syllables, _number(digest, 8 + i, 16)) for i in range(n)])
        fits = cyrillic if script == "Cyrillic" else ~cyrillic
        if gender == "n":
            names.append(F.when(fits & (kind == "surname"), F.initcap(spelled(3 + attempt))))
        first = F.concat(F.get(F.array(*[F.lit(n) for n in given]), _number(digest, 7, len(given))), spelled(attempt))
        names.append(F.when(fits & (kind == "given") & normal.startswith(f"{gender} "), F.concat(F.lit(f"{gender} "), first)))
    # the first digit of a number and the country and check digits' places of an account number stay in range
    digits = F.concat(F.substring(normal, 1, 1), _same_shape(F.substring(normal, F.lit(2), F.length(normal)), digest))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    shape = _shape(kind)
    return (
        F.when(kind == "card", F.concat(body, F.pmod(10 - _luhn(body, 0), F.lit(10)).cast("string")))
        .when(shape == "address", address).when(shape == "octets", octets).when(shape == "digits", digits)
        .when(kind.isin("given", "surname"), F.coalesce(*names)).otherwise(_same_shape(normal, digest)))


def rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate written the way the mention is."""
    # characters of the surrogate take the places of the mention's digits and letters; separators stay
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    def step(acc: Column, c: Column) -> Column:
        # what a card's mention has after its digits stays
        taken = c.rlike("^[0-9A-Za-z]$") & (acc["i"] <= F.length(surrogate))
        return F.struct(
            F.concat(acc["s"], F.when(taken, F.substring(surrogate, acc["i"], F.lit(1))).otherwise(c)).alias("s"),
            (acc["i"] + F.when(taken, 1).otherwise(0)).alias("i"))
    spaced = F.aggregate(F.split(mention, ""), start, step, lambda acc: acc["s"])
    title = F.regexp_extract(mention, r"^\S+ ", 0)
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), spaced)
        .when(kind == "given", F.concat(title, shown(kind, surrogate)))
        # after a given name only a space is left to write
        .when(kind == "surname", F.concat(
            F.when(F.size(F.split(mention, " ")) > 2, F.lit(" ")).otherwise(title), surrogate, _ending(mention)))
        .when((kind == "ip6") & mention.rlike("[A-F]"), F.upper(surrogate))
        .otherwise(surrogate))


def shown(kind: Column, name: Column) -> Column:
    """A name entity's or its surrogate's name, without the gender of a given name."""
    return F.when(kind == "given", F.substring(name, F.lit(3), F.length(name))).otherwise(name)


def bare_replaced(piece: Column, names: Column) -> Column:
    """A piece of text with the names that a map has replaced, and the number of these."""
    words = F.regexp_extract_all(piece, F.lit(BARE), F.lit(0))
    new = F.transform(words, lambda w: F.coalesce(F.concat(F.element_at(names, _stem(w)), _ending(w)), w))
    text = F.array_join(F.flatten(F.zip_with(F.split(piece, BARE, -1), new, lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
    return F.struct(text.alias("text"), F.size(F.filter(words, lambda w: F.map_contains_key(names, _stem(w)))).alias("n"))


def surrogates(mentions: DataFrame, key: str) -> DataFrame:
    """A distinct surrogate for every distinct entity, none of them an entity that occurs."""
    entities = staged(mentions.select("kind", "normal").distinct(), "entities")
    waiting, settled, attempt = entities, None, 0
    while True:
        drawn = waiting.withColumn("surrogate", candidate(F.col("kind"), F.col("normal"), key, attempt))
        real = entities.select("kind", F.col("normal").alias("surrogate"))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        # of entities with the same candidate the first one gets it
        won = staged(free.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal")), "surrogates")
        settled = won if settled is None else settled.unionByName(won)
        left = staged(waiting.join(won, ["kind", "normal"], "left_anti"), "entities-left")
        if left.isEmpty():
            return settled
        if attempt == MOST_DRAWS:
            raise ValueError("too many distinct entities of one format: no surrogates of the same format are left")
        waiting, attempt = left, attempt + 1


def replaced(docs: DataFrame, key: str, text_column: str = "text", count_column: str | None = None) -> DataFrame:
    """The table with every entity in its text replaced; other columns and rows stay as they are.

    Whoever has the key can tell which surrogate an entity got, so it has to be a secret. Null and empty texts stay so;
    repeated rows are treated alike. A name that stands after a form of address anywhere in a text is replaced wherever
    the text has it as a word; where given names of two genders, or a given name and a surname, are spelled alike,
    bare words take the surname, else the first gender's. ``count_column`` adds the number of replaced mentions.
    """
    rid, held, new, names_of, replacements = (fresh(docs, n) for n in ("_rid", "_mentions", "_new", "_names", "_replaced"))
    text = F.col(f"`{text_column}`")
    table = numbered(docs.withColumn(held, F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(EVERY), F.lit(0))),
                     "private-input", rid)
    hit = F.size(held) > 0
    each = table.where(hit).select(F.col(rid).alias("rid"), F.posexplode(held).alias("at", "mention"))
    each = each.withColumn("entities", entities_of(kind_of(F.col("mention")), F.col("mention")))
    mentions = staged(each, "mentions")
    known = mentions.select("rid", "at", "mention", F.posexplode("entities").alias("part", "e")).select("rid", "at", "mention", "part", "e.*")
    kind, surrogate = F.col("kind"), F.col("surrogate")
    name = F.when(kind.isin("given", "surname"), F.struct(
        shown(kind, F.col("normal")).alias("name"), (kind == "given").alias("rank"), shown(kind, surrogate).alias("new")))
    found = known.join(surrogates(known, key), ["kind", "normal"]).select(
        "rid", "at", "part", rendered(kind, F.col("mention"), surrogate).alias("new"), F.lit(1).alias("one"), name.alias("name"))
    none_found = mentions.where(F.size("entities") == 0).select(
        "rid", "at", F.lit(0).alias("part"), F.col("mention").alias("new"), F.lit(0).alias("one"))
    whole = found.unionByName(none_found, allowMissingColumns=True).groupBy("rid", "at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "new"))), lambda p: p["new"]), "").alias("new"),
        F.max("one").alias("one"), F.collect_list("name").alias("names"))
    by_row = whole.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("at", "new"))).alias(new), F.sum("one").alias(replacements),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias(names_of))
    # of names spelled alike the first one counts
    firsts = F.filter(names_of, lambda n, i: (i == 0) | (F.get(F.col(names_of), i - 1)["name"] != n["name"]))
    by_row = by_row.withColumn(names_of, F.map_from_entries(F.transform(firsts, lambda n: F.struct(n["name"], n["new"]))))
    changed = table.where(hit).join(by_row.withColumnRenamed("rid", rid), rid)
    named = F.size(names_of) > 0
    pieces = F.transform(F.split(text, EVERY, -1), lambda p: F.when(named, bare_replaced(p, F.col(names_of))).otherwise(
        F.struct(p.alias("text"), F.lit(0).alias("n"))))
    parts = fresh(docs, "_parts")
    changed = changed.withColumn(parts, pieces)
    joined = F.array_join(F.flatten(F.zip_with(
        F.col(parts)["text"], F.transform(F.col(new), lambda x: x["new"]), lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
    bare = F.aggregate(F.col(parts)["n"], F.lit(0).cast("long"), lambda s, n: s + n)
    counts, none = ([], []) if count_column is None else (
        [(F.col(replacements) + bare).cast("long").alias(count_column)], [F.lit(0).cast("long").alias(count_column)])
    names = [F.col(f"`{c}`") for c in docs.columns]
    done = changed.select(*[joined.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns], *counts)
    return done.unionByName(table.where(~hit).select(*names, *none))
