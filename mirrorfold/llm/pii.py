"""Personal data gives way to surrogates of the same kind: keyed, consistent, and distinct.

Built-in functions only. One pass of a pattern sets marks around the entities of each text and cuts the
text at them; the cut texts are written down, so that the pattern is not run again. Each entity's
surrogate is worked out where it stands from a keyed digest of its canonical form, so that the same entity
has the same surrogate everywhere and no text moves. The distinct entities alone are gathered, to find
surrogates that would meet each other or a real entity; those few draw again, and what they drew is handed
back to the documents.

A person is found by a title. The parts of the name, given and family, are entities of their own wherever
they stand in that text, with a title or without: Mr John Smith, Mr Smith and John Smith stay one person.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfold.llm.common import cut, need, scratch, spare, table

SETTING = "spark.mirrorfold.surrogates.key"  # where a session holds the key
TRIAL_KEY = "no secret: for trials only"  # of the registered query and the pipeline in a session without one
HANDED = 10_000  # redrawn entities that go to every task at most; more are joined
WIDER = 2  # draws after which a surrogate may take another form, where its own has too few
SYLLABLES_MORE = 4  # a name has one syllable more with each draw, up to so many
ROUNDS = 200  # a clash that is left then has no free surrogate of its form: an error, never a silent clash

MEN, WOMEN = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Lady", "Госпожа")
EITHER = ("Dr", "Prof", "Professor", "Doktor", "Доктор", "Профессор")
ENDINGS = {"m": ("an", "o", "us", "ik"), "f": ("a", "ia", "ina", "ea"), "n": ("el", "is", "en", "y"), "mc": ("ан", "ий", "ор", "им"), "fc": ("а", "ия", "ина", "ея"), "nc": ("ел", "ис", "ен", "ь")}
SYLLABLES = {"l": ("ba", "den", "fel", "gor", "hal", "kes", "lin", "mar", "nov", "per", "ros", "sen", "tor", "ul", "ver", "wil"), "c": ("ба", "вел", "гор", "дан", "кор", "лин", "мар", "нов", "пет", "рос", "сен", "тар", "фед", "чер", "шин", "юр")}

_TITLE = "|".join(sorted((*MEN, *WOMEN, *EITHER), key=len, reverse=True))
_NAME = r"(?!(?:" + _TITLE + r")\b)(?:\p{Lu}')?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_FIRST = "".join(dict.fromkeys(t[0] for t in (*MEN, *WOMEN, *EITHER)))
_TITLES = r"(?:(?:" + _TITLE + r")\.? ){1,4}"
TITLED = r"(?=[" + _FIRST + r"])(?<!\p{L})" + _TITLES + r"(?:\p{Lu}\. ){0,3}" + _NAME + r"(?: " + _NAME + r"){0,2}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Classes repeat without bounds, and no group does, so that neither long entities nor long texts cost a deep stack.
PATTERN = "|".join(
    (
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}-]++\.[\p{L}\p{N}])[\p{L}\p{N}.-]*[\p{L}\p{N}]",  # mail
        r"(?<=[=:\"'\s])(?<=[=:]\s{0,3}[\"']?)(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_.~=-]{7,}[A-Za-z0-9+/_~=-]",  # secret that is named
        r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})(?![\p{L}\p{N}])",  # secret by its form
        r"(?<![\d.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\d|\.\d)",  # internet address
        r"(?<![\p{L}\p{N}:.])(?=[A-Fa-f:]{0,12}[0-9])(?:(?:" + _HEX + r":){7}" + _HEX + r"|(?:" + _HEX + r":){1,6}(?::" + _HEX + r"){1,6})(?![\p{L}\p{N}:])",  # the longer internet address
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",  # social security number
        r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})|\(\d{3}\))[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",  # phone
        r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",  # bank account
        r"(?<![\d.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)",  # card
    )
)
#: What every entity has somewhere before or in it; texts without it are left alone at once. One look at a
#: character passes over most places.
_REST = "|".join(dict.fromkeys(t[1:] for t in (*MEN, *WOMEN, *EITHER)))
_TITLE_HINT = r"[" + _FIRST + r"](?:" + _REST + r")\.? \p{Lu}"
HINT = r"[0-9@]|" + _TITLE_HINT + r"|[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.~=-]{8}|AKIA|ghp_"
MARK = "\ufdd0"  # no character; a text that holds it is marked by a longer mark of its own


def named(name: Column) -> Column:
    """A titled mention as a struct: gender (m, f or n), given names, family name."""
    titles = F.regexp_extract(name, "^" + _TITLES, 0)
    has = lambda some: titles.rlike(r"(?<!\p{L})(?:" + "|".join(some) + r")\.? ")
    parts = F.split(F.regexp_replace(F.substr(name, F.length(titles) + 1, F.length(name)), r"\p{Lu}\. ", ""), " ")
    gender = F.when(has(WOMEN), F.lit("f")).when(has(MEN), F.lit("m")).otherwise(F.lit("n"))
    return F.struct(gender.alias("gender"), F.slice(parts, 1, F.size(parts) - 1).alias("given"), F.element_at(parts, -1).alias("family"))


def kind_of(e: Column, families: Column, given: Column) -> Column:
    tests = (("mail", "@"), ("address", r"^\d{1,3}(\.\d{1,3}){3}$"), ("address6", r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), ("number", r"^\d{3}-\d{2}-\d{4}$"), ("phone", r"^[+(]"), ("card", r"^\d[\d -]{11,24}\d$"), ("account", r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"))
    other = reduce(lambda rest, t: F.when(e.rlike(t[1]), F.lit(t[0])).otherwise(rest), reversed(tests), F.lit("secret"))
    return F.when(F.array_contains(families, e), F.lit("family")).when(F.array_contains(given, e), F.lit("given")).otherwise(other)


def canonical(kind: Column, e: Column, gender: Column) -> Column:
    """What makes two mentions the same: case and separators don't, the gender that a text gives a given name does."""
    return F.when(kind.isin("mail", "address6"), F.lower(e)).when(kind.isin("phone", "card", "account", "number"), F.regexp_replace(F.upper(e), r"[^A-Z0-9]", "")).when(kind == "given", F.concat(gender, F.lit(":"), e)).when((kind == "secret") & e.rlike("^[0-9A-Fa-f]{32,}$"), F.lower(e)).otherwise(e)


def digest(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits, keyed within and without."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)), 512)


def number(hexes: Column, at: Column, digits: int = 4) -> Column:
    return F.conv(F.substr(hexes, (at * 3) % F.lit(128 - digits) + 1, F.lit(digits)), 16, 10).cast("int")


def reshaped(text: Column, hexes: Column, hexadecimal: Column) -> Column:
    """Each letter and digit gives way to one of its class and script; signs stay. Beyond the digest's digits, a digest of it goes on."""

    def one(c: Column, at: Column) -> Column:
        v = number(F.when(at < 40, hexes).otherwise(F.sha2(F.concat(hexes, F.floor(at / 40).cast("string")), 512)), at % 40)
        letter = lambda first, n: F.chr(F.lit(first) + F.pmod(v, n))
        small, capital = F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26)), F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26))
        wide = lambda alphabet: F.substr(F.lit(alphabet), F.pmod(v, F.lit(len(alphabet))) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), F.pmod(v, F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), letter(97, small)).when(c.rlike("[A-Z]"), letter(65, capital))
            .when(c.rlike(r"(?=\p{Ll})\p{IsCyrillic}"), wide("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{IsCyrillic}"), wide("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
            .when(c.rlike(r"(?=\p{Ll})\p{IsGreek}"), wide("αβγδεζηθικλμνξοπρστυφχψω")).when(c.rlike(r"\p{IsGreek}"), wide("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))
            .when(c.rlike(r"\p{Ll}"), letter(97, F.lit(26))).when(c.rlike(r"\p{Lu}"), letter(65, F.lit(26))).otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10; 0 is valid."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, at: F.when(at % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, x: a + x), F.lit(10))


def name_like(e: Column, gender: Column, hexes: Column, draw: Column, family: Column) -> Column:
    """A name of the same script, part and gender; longer with each draw, so that there are enough. Hyphens and apostrophes are not kept."""
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), F.pmod(number(hexes, F.lit(at)), F.lit(len(names))) + 1)
    cyrillic = e.rlike(r"\p{IsCyrillic}")
    syllable = lambda at: F.when(cyrillic, pick(SYLLABLES["c"], at)).otherwise(pick(SYLLABLES["l"], at))
    more = [F.when(draw > k, syllable(17 + 4 * k)).otherwise(F.lit("")) for k in range(SYLLABLES_MORE)]
    ending = reduce(lambda rest, g: F.when(gender == g, F.when(cyrillic, pick(ENDINGS[g + "c"], 13)).otherwise(pick(ENDINGS[g], 13))).otherwise(rest), ("m", "f"), F.when(cyrillic, pick(ENDINGS["nc"], 13)).otherwise(pick(ENDINGS["n"], 13)))
    feminine = F.when(cyrillic & e.rlike("[ая]$"), F.lit("а")).otherwise(F.lit(""))
    return F.initcap(F.when(family, F.concat(syllable(5), syllable(9), *more, syllable(13), feminine)).otherwise(F.concat(syllable(5), *more, ending)))


def surrogate(kind: Column, e: Column, same: Column, draw: Column, key: str) -> Column:
    """The entity's replacement; `same` is its canonical form and `draw` how often it drew again."""
    digests = F.struct(digest(key, kind, same, draw.cast("string")).alias("own"), digest(key, F.lit("domain"), F.lower(F.substring_index(e, "@", -1))).alias("domain"))
    # as a lambda's variable the digests are worked out once, not for each character
    return F.element_at(F.transform(F.array(digests), lambda x: replaced(kind, e, same, draw, x["own"], x["domain"])), 1)


def replaced(kind: Column, e: Column, same: Column, draw: Column, hexes: Column, of_domain: Column) -> Column:
    yes, no = F.lit(True), F.lit(False)
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    head, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.substring_index(domain, ".", -1)
    more = F.when(draw > WIDER, F.pmod(number(hexes, F.lit(40), 6), F.lit(1_000_000)).cast("string")).otherwise(F.lit(""))
    mail = F.concat(reshaped(local, hexes, no), more, F.lit("@"), reshaped(head, of_domain, no), F.lit("."), top)
    octets = F.transform(F.split(e, r"\."), lambda o, at: F.when(draw > WIDER, F.pmod(number(hexes, at), F.lit(256))).when(F.length(o) == 1, F.pmod(number(hexes, at), F.lit(10))).when(F.length(o) == 2, F.pmod(number(hexes, at), F.lit(90)) + 10).otherwise(F.pmod(number(hexes, at), F.lit(156)) + 100).cast("string"))
    groups = F.transform(F.split(e, ":", -1), lambda g, at: F.when(g == "", g).when(draw > WIDER, F.substr(hexes, at * 4 + 64, F.lit(4))).otherwise(reshaped(g, F.substr(hexes, at * 8 + 1, F.lit(64)), yes)))
    # signs are set where the mention has them, digits follow their order in the canonical form
    signs = lambda digits: F.array_join(F.transform(F.filter(F.split(e, ""), lambda c: c != ""), lambda c, at: F.when(c.rlike("[A-Za-z0-9]"), F.substr(digits, F.length(F.regexp_replace(F.substr(e, F.lit(1), at + 1), "[^A-Za-z0-9]", "")), F.lit(1))).otherwise(c)), "")
    fixed = F.when(kind.isin("phone", "card"), F.lit(1)).when(kind == "account", F.lit(2)).otherwise(F.lit(0))
    body = F.concat(F.substr(same, F.lit(1), fixed), reshaped(F.substr(same, fixed + 1, F.length(same)), hexes, no))
    base = F.substr(body, F.lit(1), F.length(body) - 1)
    checked = F.concat(base, F.pmod(10 - luhn(F.concat(base, F.lit("0"))), F.lit(10)).cast("string"))
    card = F.when(luhn(same) == 0, checked).otherwise(body)
    return (
        F.when(kind == "mail", mail).when(kind == "address", F.array_join(octets, ".")).when(kind == "address6", F.array_join(groups, ":")).when(kind == "card", signs(card)).when(kind.isin("phone", "account", "number"), signs(body))
        .when(kind == "family", name_like(e, F.lit("n"), hexes, draw, yes)).when(kind == "given", name_like(e, F.substr(same, F.lit(1), F.lit(1)), hexes, draw, no))
        .when(e.rlike("^[0-9A-Fa-f]{32,}$"), reshaped(e, hexes, yes)).otherwise(F.concat(reshaped(e, hexes, no), more))
    )


def marked(docs: DataFrame) -> DataFrame:
    """row (the document, its text null where it is cut), pieces (between entities) and found (structs of e, kind, same); both null without entities."""
    text = F.when(F.col("text").rlike(HINT), F.col("text"))
    people = F.transform(F.regexp_extract_all(F.when(text.rlike(_TITLE_HINT), text), F.lit(TITLED), F.lit(0)), named)
    told = docs.select(F.struct("*").alias("row"), text.alias("told"), F.coalesce(people, F.array().cast("array<struct<gender:string,given:array<string>,family:string>>")).alias("people"))
    of = lambda gender: F.flatten(F.transform(F.filter("people", lambda p: p["gender"] == gender), lambda p: p["given"]))
    told = told.select("row", "told", F.array_distinct(F.transform("people", lambda p: p["family"])).alias("families"), F.array_distinct(F.flatten(F.transform("people", lambda p: p["given"]))).alias("given"), of("f").alias("women"), of("m").alias("men"))
    names = F.array_join(F.reverse(F.array_sort(F.transform(F.array_union("families", "given"), lambda n: F.struct(F.length(n), n.alias("n")))))["n"], "|")
    pattern = F.when(F.size("families") == 0, F.lit(PATTERN)).otherwise(F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), names, F.lit(r")(?![\p{L}\p{N}])")))
    mark = F.when(F.contains("told", F.lit(MARK)), F.concat(F.lit(MARK), F.sha2("told", 256), F.lit(MARK))).otherwise(F.lit(MARK))
    cutting = told.withColumn("mark", mark).withColumn("parts", F.split(F.regexp_replace("told", pattern, F.concat("mark", F.lit("$0"), "mark")), F.col("mark"), -1))
    gender = lambda e: F.when(F.array_contains("women", e), F.lit("f")).when(F.array_contains("men", e), F.lit("m")).otherwise(F.lit("n"))
    kinds = F.transform(F.filter("parts", lambda _, at: at % 2 == 1), lambda e: F.struct(e.alias("e"), kind_of(e, F.col("families"), F.col("given")).alias("kind")))
    entities, cuts = F.transform(kinds, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), canonical(x["kind"], x["e"], gender(x["e"])).alias("same"))), F.size("parts") > 1
    return cutting.select(
        F.col("row").withField("text", F.when(cuts, F.lit(None)).otherwise(F.col("row.text"))).alias("row"),
        F.when(cuts, F.filter("parts", lambda _, at: at % 2 == 0)).alias("pieces"), F.when(cuts, entities).alias("found"),
    )


def redrawn(found: DataFrame, key: str) -> DataFrame:
    """same (with its kind before it), draw: the entities whose first surrogate meets another's or a real entity.

    They draw until no two entities of a kind have the same surrogate and none has a real entity's.
    """
    some = found.where(F.col("found").isNotNull()).select(F.explode("found").alias("x")).select("x.kind", "x.same", "x.e")
    real = cut(some.groupBy("kind", "same").agg(F.min("e").alias("e")))
    now = real.withColumn("draw", F.lit(0))
    bare = lambda kind, s: F.when(kind.isin("phone", "card", "account", "number"), F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")).otherwise(F.lower(s))
    plain = lambda kind, s: F.element_at(F.transform(F.array(s), lambda x: bare(kind, x)), 1)
    originals = real.select("kind", plain(F.col("kind"), F.col("e")).alias("plain")).distinct()
    for _ in range(ROUNDS):
        drawn = cut(now.withColumn("plain", plain(F.col("kind"), surrogate(F.col("kind"), F.col("e"), F.col("same"), F.col("draw"), key))))
        first = drawn.groupBy("kind", "plain").agg(F.min("same").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "plain", "first")
        twice = drawn.join(first, ["kind", "plain"]).where("same <> first").select("kind", "same")
        taken = drawn.join(originals, ["kind", "plain"], "left_semi").select("kind", "same")
        clash = cut(twice.unionByName(taken).distinct())
        if clash.isEmpty():
            break
        now = drawn.join(clash.withColumn("again", F.lit(1)), ["kind", "same"], "left").select("kind", "same", "e", (F.col("draw") + F.coalesce("again", F.lit(0))).alias("draw"))
    else:
        raise ValueError(f"after {ROUNDS} draws entities still share surrogates: {[r['kind'] for r in clash.select('kind').distinct().collect()]}")
    return drawn.where("draw > 0").select(F.concat_ws("|", "kind", "same").alias("same"), "draw")


def joined(pieces: Column, put: Column) -> Column:
    return F.array_join(F.zip_with(pieces, put, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def session_key(spark: SparkSession) -> str:
    """The session's key; TRIAL_KEY where none is set."""
    return spark.conf.get(SETTING, None) or TRIAL_KEY


def with_surrogates(docs: DataFrame, key: str, handed: int = HANDED) -> DataFrame:
    """The documents with surrogates in `text`, and n_entities behind the others (n_entities_ and so on if they have such a column).

    Whoever holds the key can tell an entity's surrogate, so it is the caller's to give. Null texts stay
    null, texts without entities as they are, byte for byte. Mentions that differ in case or separators
    alone count as the same; equal texts stay equal. Columns of any other name pass through. Repeated rows
    stay. No rows: no result rows. The cut texts lie in a scratch folder until release().
    """
    if not key:
        raise ValueError("surrogates need a key")
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "surrogates")
    marked(docs).write.parquet(folder)
    split = spark.read.parquet(folder)
    again = cut(redrawn(split.select("found"), key))
    put = lambda x, draw: surrogate(x["kind"], x["e"], x["same"], draw, key)
    n = again.count()
    if n == 0:
        made = split.withColumn("put", F.transform("found", lambda x: put(x, F.lit(0))))
    elif n <= handed:
        held = F.broadcast(again.agg(F.map_from_entries(F.collect_list(F.struct("same", "draw"))).alias("draws")))  # `handed` entries at most
        made = split.crossJoin(held).withColumn("put", F.transform("found", lambda x: put(x, F.coalesce(F.col("draws")[F.concat_ws("|", x["kind"], x["same"])], F.lit(0)))))
    else:
        rows = cut(split.withColumn("at", F.monotonically_increasing_id()))
        each = rows.where(F.col("found").isNotNull()).select("at", F.posexplode("found").alias("nth", "x")).withColumn("same", F.concat_ws("|", "x.kind", "x.same"))
        each = each.join(again, "same", "left").select("at", "nth", put(F.col("x"), F.coalesce("draw", F.lit(0))).alias("s"))
        made = rows.join(each.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "s"))), lambda x: x["s"]).alias("put")), "at", "left")
    text = F.when(F.col("put").isNotNull(), joined(F.col("pieces"), F.col("put"))).otherwise(F.col("row.text"))
    return made.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns), F.when(F.col("found").isNotNull(), F.size("found")).otherwise(F.lit(0)).alias(spare(docs, "n_entities")))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(need(table(spark, sf_dir, "documents"), "doc_id", "text"), session_key(spark))
