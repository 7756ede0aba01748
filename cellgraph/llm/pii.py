"""PII surrogates: detected entities get keyed, type-consistent replacements.

One pattern finds the entities; a text is cut at them and put together again
with surrogates in their places. A surrogate is a pure function of (secret,
type, normalised entity, attempt): equal entities get equal surrogates
everywhere (coreference), digits stay digits, letters keep case, separators
stay, card numbers keep a valid check digit, addresses stay addresses, and
names keep the gender of their title and their script. All distinct entities
are checked: where two would get one surrogate, or a surrogate is itself an
entity of the corpus or unchanged, all but one take the next attempt. The few
entities with a later attempt are looked up; no text moves for the others.
Characters outside ASCII, and all characters of an entity without a letter or
digit, become letters. From attempt ``NARROW`` on a surrogate gives up the
entity's form for one too large to be used up, so the checks end for any input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, release

MALE = "Mr|Herr|Monsieur|Señor|Sir"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora"
TITLE = rf"(?:{FEMALE}|{MALE})\.?"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE} \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.\d)"
HEXES = r"[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around a double colon with three hexadecimal digits in a row (so that ``a[1::2]`` is none).
IP6 = rf"(?<![\w:.])(?:(?:{HEXES}:){{7}}{HEXES}|(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?:{HEXES}(?::{HEXES}){{0,6}})?::(?:{HEXES}(?::{HEXES}){{0,6}})?)(?![\w:]|\.\d)"
PHONE = r"(?<![\w.+])\+(?=(?:[ .()-]{0,3}\d){7})[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,12}(?:[ .-]\d{2,4}){0,5}(?!\w)|(?<![\w.])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w.-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])|(?<![\w.-])\d{4}[ -]\d{6}[ -]\d{4,5}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)|(?<!\w)[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?<=\d[A-Z0-9]{0,3})(?!\w)"
SECRET = r"(?<!\w)AKIA[A-Z0-9]{12,}+(?!\w)|(?<=(?i:password|passwd|secret|token|api_?key) {0,2}[=:] {0,2}\"?)[^\s\"]{6,}+"
PATTERN = "|".join((NAME, EMAIL, IP6, IP, SSN, PHONE, CARD, IBAN, SECRET))
#: Texts without any of these hold no entity; a cheap test before the pattern.
HINT = rf"[0-9@]|:[0-9A-Fa-f]{{0,4}}:|{TITLE} |(?i:password|passwd|secret|token|api_?key) {{0,2}}[=:]"
MOST_IN_PLAN = 1000
#: So many attempts keep the entity's form.
NARROW = 12

#: Consonants, vowels and the endings of a woman's first name, a man's and a surname, for each script.
SCRIPTS = {
    "Latin": ("bdfgklmnprstvz", "aeiou", "na", "n", "k"),
    "Cyrillic": ("бдфгклмнпрствз", "аеиоу", "на", "н", "к"),
    "Greek": ("βγδζθκλμνπρστφ", "αειου", "να", "ν", "κ"),
}
#: A key for the test tables only; for data of your own set ``spark.cellgraph.pii.key`` or pass ``secret``.
TEST_KEY = "test tables"


def entities(text: Column) -> Column:
    """All entities of a text, in order; none for null."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def _luhn(a: Column) -> Column:
    """Check sum of digits counted from the right."""
    return F.aggregate(F.transform(a, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda t, x: t + x) % 10


def type_of(e: Column) -> Column:
    """email, name, ip, ip6, ssn, iban, secret, phone or card; none for numbers that are no card: another first digit than 2 to 6, or a wrong check digit."""
    only = F.regexp_replace(e, "[^0-9]", "")
    digits = F.length(only)
    card = only.rlike("^[2-6]") & (_luhn(F.transform(F.reverse(F.split(only, "")), lambda c: c.try_cast("int"))) == 0)
    return (
        F.when((digits == 0) & ~e.rlike(r"[^ .()+-]"), "secret").when(e.contains("@") & e.rlike(f"^(?:{EMAIL})$"), "email").when(e.rlike(f"^{TITLE} "), "name").when(e.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$"), "ip")
        .when(e.rlike(f"^(?:{IP6})$"), "ip6").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike(r"^[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)$"), "iban").when(e.rlike(r"[^0-9 .()+-]"), "secret")
        .when(e.rlike(r"[(+.]") | (digits <= 12), "phone").when(card, "card").otherwise("none")
    )


def _normal(e: Column, kind: Column) -> Column:
    digits = F.regexp_replace(e, "[^0-9]", "")
    gender = F.when(e.rlike(f"^(?:{FEMALE})[. ]"), "f").otherwise("m")
    body = (
        F.when(kind.isin("email", "ip6"), F.lower(e)).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(kind == "phone", F.substring(digits, -10, 10)).when(kind.isin("ssn", "card"), digits)
        .when(kind == "name", F.concat(gender, F.lit(" "), F.lower(F.regexp_replace(e, f"^{TITLE} ", "")))).otherwise(e)
    )
    return F.concat(kind, F.lit("|"), body)


def described(found: Column) -> Column:
    """For each entity (e, kind, key): key is what makes two mentions one entity, its type with digits, case-folded text or gender and name.

    Each step is a transform of its own: later ones refer to its result, so that nothing is computed twice.
    """
    typed = F.transform(found, lambda e: F.struct(e.alias("e"), type_of(e).alias("kind")))
    return F.transform(typed, lambda s: F.struct(s["e"].alias("e"), s["kind"].alias("kind"), _normal(s["e"], s["kind"]).alias("key")))


def _letters(s: Column) -> Column:
    """Each letter and digit by another of its kind, but for positions outside [s.low, s.high); others by letters where they are not ASCII or where s.bare."""

    def char(c: Column, i: Column) -> Column:
        # blocks of an IBAN do not count the spaces between them
        byte = F.element_at(s["bytes"], (i - F.when(s["blocks"], F.floor(i / 5)).otherwise(0)).cast("int") % 64 + 1)
        code = F.ascii(c)
        new = (
            F.when(code.between(48, 57), F.char(48 + byte % 10)).when(code.between(97, 122), F.char(97 + byte % F.when(s["hexa"], 6).otherwise(26)))
            .when(code.between(65, 90), F.char(65 + byte % F.when(s["hexa"], 6).otherwise(26))).when((code > 127) | (s["bare"] & ~c.isin("@", ".")) | (s["bare"] & (s["kind"] != "email")), F.char(97 + byte % 26)).otherwise(c)
        )
        return F.when((i < s["low"]) | (i >= s["high"]), c).otherwise(new)

    return F.array_join(F.transform(F.split(s["e"], ""), char), "")


def _digits(rows: Column) -> Column:
    """Digits by digits, counted from the right; a phone keeps its country code, a card its first digit and a valid check digit."""
    old = F.transform(rows, lambda s: F.struct(s["e"].alias("e"), s["kind"].alias("kind"), s["bytes"].alias("bytes"), F.transform(F.reverse(F.split(F.regexp_replace(s["e"], "[^0-9]", ""), "")), lambda c: c.try_cast("int")).alias("old")))

    def raw(s: Column) -> Column:
        card, phone, n = s["kind"] == "card", s["kind"] == "phone", F.size(s["old"])

        def digit(d: Column, i: Column) -> Column:
            byte = F.element_at(s["bytes"], i % 64 + 1)
            return F.when((card & (i == n - 1)) | (phone & (i >= 10)), d).when(card & (i == 0), F.lit(0)).when(phone & i.isin(6, 9), 2 + byte % 8).otherwise(byte % 10).cast("int")

        return F.struct(s["e"].alias("e"), s["kind"].alias("kind"), s["bytes"].alias("bytes"), s["old"].alias("old"), F.transform(s["old"], digit).alias("raw"))

    def last(s: Column) -> Column:
        check = F.when(_luhn(s["old"]) == 0, (10 - _luhn(s["raw"])) % 10).otherwise(F.element_at(s["bytes"], 1) % 10)
        first = F.when(s["kind"] == "card", check).otherwise(F.element_at(s["raw"], 1)).cast("int")
        return F.struct(s["e"].alias("e"), F.concat(F.array(first), F.slice(s["raw"], 2, F.greatest(F.size(s["raw"]) - 1, F.lit(0)))).alias("new"))

    def woven(s: Column) -> Column:
        rest = F.aggregate(
            F.split(s["e"], ""),
            F.struct(F.lit("").alias("out"), F.size(s["new"]).alias("at")),
            lambda t, c: F.when(F.ascii(c).between(48, 57), F.struct(F.concat(t["out"], F.element_at(s["new"], t["at"]).cast("string")).alias("out"), (t["at"] - 1).alias("at"))).otherwise(F.struct(F.concat(t["out"], c).alias("out"), t["at"].alias("at"))),
        )
        return rest["out"]

    return F.transform(F.transform(F.transform(old, raw), last), woven)


def _name(s: Column) -> Column:
    """The title, then made-up names of as many words; the ending tells the gender, the letters the script."""
    e = s["e"]

    def of_script(at: int) -> Column:
        return F.when(s["script"] == "Cyrillic", SCRIPTS["Cyrillic"][at]).when(s["script"] == "Greek", SCRIPTS["Greek"][at]).otherwise(SCRIPTS["Latin"][at])

    def syllable(k: Column) -> Column:
        return F.concat(F.substring(of_script(0), F.element_at(s["bytes"], k) % 14 + 1, F.lit(1)), F.substring(of_script(1), F.element_at(s["bytes"], k + 20) % 5 + 1, F.lit(1)))

    syllables = F.transform(F.sequence(F.lit(1), F.lit(6)), syllable)
    ending = F.when(s["female"], of_script(2)).otherwise(of_script(3))
    part = lambda lo, n: F.array_join(F.slice(syllables, lo, n), "")
    two = F.concat(F.initcap(F.concat(part(1, 2), ending)), F.lit(" "), F.initcap(F.concat(part(3, 4), of_script(4))))
    title = F.regexp_extract(e, f"^({TITLE} )", 1)
    wide = F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), syllable), ""), ending))
    return F.concat(title, F.when(s["wide"], wide).when(F.size(F.split(e, " ")) > 2, two).otherwise(F.initcap(F.concat(part(3, 4), ending))))


def surrogates(rows: Column, attempt, secret: str) -> Column:
    """Replacements of entities (e, kind, key); ``attempt`` gives the attempt of a key."""
    hashed = F.transform(rows, lambda s: F.struct(s["e"].alias("e"), s["kind"].alias("kind"), F.concat(F.lit(secret), F.lit("|"), s["key"], F.lit("|"), attempt(s["key"]).cast("string")).alias("seed"), (attempt(s["key"]) >= NARROW).alias("wide")))
    hexes = F.transform(hashed, lambda s: F.struct(s["e"].alias("e"), s["kind"].alias("kind"), s["wide"].alias("wide"), F.concat(F.sha2(F.concat(s["seed"], F.lit("|0")), 256), F.sha2(F.concat(s["seed"], F.lit("|1")), 256)).alias("hex")))
    full = F.transform(hexes, lambda s: F.struct(s["e"].alias("e"), s["kind"].alias("kind"), s["wide"].alias("wide"), s["hex"].alias("hex"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(s["hex"], 2 * i + 1, F.lit(2)), 16, 10).cast("int")).alias("bytes")))

    def marked(s: Column) -> Column:
        e, kind = s["e"], s["kind"]
        domain = F.length(F.regexp_extract(e, r"((?i:\.example)?\.[A-Za-z]+)$", 1))
        low = F.when((kind == "secret") & e.startswith("AKIA"), 4).when(kind == "iban", 2).otherwise(0)
        high = F.length(e) - F.when(kind == "email", domain).otherwise(0)
        bare = ~F.substring(e, low + 1, high - low).rlike("[A-Za-z0-9]")
        return F.struct(e.alias("e"), kind.alias("kind"), s["wide"].alias("wide"), s["hex"].alias("hex"), s["bytes"].alias("bytes"), low.alias("low"), high.alias("high"), bare.alias("bare"), ((kind == "iban") & e.contains(" ")).alias("blocks"), ((kind == "ip6") | e.rlike("^[0-9a-f]+$")).alias("hexa"), e.rlike(f"^(?:{FEMALE})[. ]").alias("female"), F.when(e.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(e.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin").alias("script"))

    def one(s: Column, digits: Column) -> Column:
        address = F.array_join(F.transform(F.split(s["e"], r"\."), lambda o, i: (1 + F.element_at(s["bytes"], i + 1) % 254).cast("string")), ".")
        wide = F.concat(F.substring(s["hex"], 1, 40), F.when(s["kind"] == "email", "@mail.example.com").otherwise(""))
        return F.when(s["kind"] == "none", s["e"]).when(s["kind"] == "name", _name(s)).when(s["wide"], wide).when(s["kind"].isin("email", "secret", "iban", "ip6"), _letters(s)).when(s["kind"] == "ip", address).otherwise(digits)

    rows = F.transform(full, marked)
    return F.zip_with(rows, _digits(full), one)


def later_attempts(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """key (normal form), attempt: the entities whose surrogate is not the first attempt, after all collision checks."""
    found = docs.select(F.explode(entities(F.col(text_col).cast("string"))).alias("e"))
    known = found.distinct().select(F.explode(described(F.array("e"))).alias("s")).filter("s.kind <> 'none'").groupBy(F.col("s.key").alias("key")).agg(F.min("s.e").alias("e"))
    known = materialize(known.withColumn("attempt", F.lit(0)), "entities")
    while True:
        made = known.select("key", "e", "attempt", F.explode(surrogates(described(F.array("e")), lambda _: F.col("attempt"), secret)).alias("made"))
        new = materialize(made.select("key", "e", "attempt", F.explode(described(F.array("made"))).alias("s")).select("key", "e", "attempt", F.col("s.key").alias("new")), "made")
        shared = new.groupBy("new").agg(F.min("key").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("new", "owner")
        taken = new.select("new").join(known.select(F.col("key").alias("new")), "new", "left_semi").distinct().withColumn("owner", F.lit(""))
        clash = materialize(shared.union(taken).groupBy("new").agg(F.min("owner").alias("owner")), "clashes")
        if clash.isEmpty():
            release(clash)
            break
        bumped = new.join(clash, "new", "left")
        after = materialize(bumped.select("key", "e", (F.col("attempt") + F.when(F.col("owner").isNotNull() & (F.col("owner") != F.col("key")), 1).otherwise(0)).alias("attempt")), "entities")
        release(known, clash)
        known = after
    return known.filter("attempt > 0").select("key", "attempt")


def mentions(found: Column, made: Column) -> Column:
    """(old, new) of the names among a text's entities as they stand without their title: full names, then surnames that one of them has."""
    body = lambda c: F.regexp_replace(c, f"^{TITLE} ", "")
    names = F.array_distinct(F.filter(F.zip_with(found, made, lambda s, m: F.struct(s["kind"].alias("kind"), body(s["e"]).alias("old"), body(m).alias("new"))), lambda p: (p["kind"] == "name") & p["old"].contains(" ")))
    full = F.transform(names, lambda p: F.struct(p["old"].alias("old"), p["new"].alias("new")))
    last = F.transform(names, lambda p: F.struct(F.substring_index(p["old"], " ", -1).alias("old"), F.substring_index(p["new"], " ", -1).alias("new")))
    alone = F.filter(last, lambda p: F.size(F.filter(last, lambda q: q["old"] == p["old"])) == 1)
    return F.concat(full, alone)


def replace_pii(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with every entity in ``text_col`` replaced, and ``pii_types`` (the types found, in order).

    Where a text names somebody with a title, the full name without it, and the
    surname if no other person there has it, become the same surrogate.
    Null, empty and entity-free texts are returned as they are, with no types.
    Columns named ``pii_types``, ``__s``, ``__m``, ``__t`` or ``__attempts`` in the input are replaced
    or dropped. Rows may repeat. An empty table gives an empty result.
    Who holds ``secret`` can recompute surrogates, nobody can invert them.
    """
    text = F.col(text_col).cast("string")
    docs = docs.drop("__s", "__m", "__t", "__attempts")
    later = materialize(later_attempts(docs.select(text_col), secret, text_col), "later")
    n = later.count()
    rows = docs
    if n == 0:
        attempt = lambda key: F.lit(0)
    elif n <= MOST_IN_PLAN:
        pairs = later.collect()  # at most MOST_IN_PLAN
        table = F.create_map(*[F.lit(x) for r in pairs for x in (r[0], r[1])])
        attempt = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(0))
    else:
        keyed = docs.select(F.xxhash64(text_col).alias("__t"), F.explode(described(entities(text))).alias("s")).select("__t", F.col("s.key").alias("key"))
        maps = keyed.distinct().join(later, "key").groupBy("__t").agg(F.map_from_entries(F.collect_list(F.struct("key", "attempt"))).alias("__attempts"))
        maps = materialize(maps, "attempts")
        rows = docs.withColumn("__t", F.xxhash64(text_col)).join(maps, "__t", "left").drop("__t")
        attempt = lambda key: F.coalesce(F.try_element_at("__attempts", key), F.lit(0))
    # the pattern runs once for the entities and once for the text between them, on texts with a hint only
    cut = rows.withColumn("__s", described(entities(text))).withColumn("__m", F.when(F.size("__s") > 0, surrogates(F.col("__s"), attempt, secret)))
    named = F.exists("__s", lambda s: (s["kind"] == "name") & (F.size(F.split(s["e"], " ")) > 2))

    def unnamed(part: Column) -> Column:
        return F.aggregate(mentions(F.col("__s"), F.col("__m")), part, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), p["old"], F.lit(r"\E(?![\p{L}\p{N}])")), p["new"]))

    parts = F.split(text, PATTERN, -1)
    parts = F.when(named, F.transform(parts, unnamed)).otherwise(parts)
    joined = F.array_join(F.zip_with(parts, F.col("__m"), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    types = F.filter(F.transform("__s", lambda s: s["kind"]), lambda k: k != "none")
    out = cut.withColumn("pii_types", types).withColumn(text_col, F.when(F.size("pii_types") > 0, joined).otherwise(F.col(text_col)))
    return out.drop("__s", "__m", "__attempts")


def key_of(spark) -> str:
    return spark.conf.get("spark.cellgraph.pii.key", TEST_KEY)


def op8_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced."""
    return replace_pii(load(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark)).select("doc_id", "text", F.size("pii_types").alias("n_entities"), F.array_join("pii_types", ",").alias("types"))
