"""Personal data and keyed surrogates, in DataFrame operations only.

Entities are found by one pattern.  Each is broken into atoms with a normal form: the digits of
a number, a whole address, each name of a person.  An atom's surrogate is drawn from a keyed
hash of its normal form, so the same entity gets the same surrogate wherever and however it is
written; it keeps type, script, letter case, length and format, a card number's check-digit
remainder, and for names the gender that a form of address tells.  Distinct atoms keep distinct
surrogates: those that collide with one another, or with any original, are drawn again, the
smaller normal form keeping its own; addresses and names grow where their values run short, and
numbers that still collide after ROUNDS draws are dealt the free values of their form.  Only a
form with fewer values than originals and surrogates together raises.

A person is found by a form of address; then each of the person's names is replaced wherever it
stands as a whole word in the same text, in its own letters or in capitals.  Phone numbers are
found by +, brackets or the groups of PLAIN.  A person that no form of address names in a text
is not found there.

Defined results: null texts stay null; texts without entities stay as they are; repeated rows
each get the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.scratch import written
from sieveline.llm.textkit import without

# Loops are possessive and begin behind a lookbehind: linear in the text, without recursion.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)"
CARD = r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)"
#: Phone numbers without a country's code or brackets: 555-123-4567, 06 12 34 56 78.
PLAIN = r"(?<![\d.+])(?<!\d[ -])(?:1[ .-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}\x20\d{3}\x20\d{4}|0\d(?:[ .-]\d{2}){4})(?![\d.-]*\d)"
#: Forms of address, for men, for women and for either.
MEN = r"Mr\.?|Herr|Señor|Sr\.|Monsieur|Господин"
WOMEN = r"Mrs\.?|Ms\.?|Frau|Señora|Sra\.|Madame|Mme|Госпожа"
EITHER = r"Dr\.?|Prof\.?"
NAME = rf"(?<!\p{{L}})(?:{MEN}|{WOMEN}|{EITHER})\x20\p{{Lu}}\p{{Ll}}++(?:[\x20-]\p{{Lu}}\p{{Ll}}++)?"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IP, CARD, SSN, PHONE, PLAIN, NAME))
#: Cheap patterns of which every entity has one.
HINT = rf"@|\d{{3}}|\d\.\d|\+\d|0\d[ -]\d\d[ -]|(?:{MEN}|{WOMEN}|{EITHER})\x20\p{{Lu}}"
#: Rounds of random draws for numbers, before the rest is dealt out among free values.
ROUNDS = 12

_CONSONANTS, _VOWELS = "bcdfghjklmnprstvz", "aeiou"
_CYR_CONSONANTS, _CYR_VOWELS = "бвгдзклмнпрстф", "аеиоу"


def kind_of(surface: Column) -> Column:
    whole = lambda p: surface.rlike(f"^(?:{p})$")
    return F.when(surface.contains("@"), "email").when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), "ip").when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn").when(whole(r"(?:\d{4}[ -]?){3}\d{4}"), "card").when(surface.rlike(r"^\p{L}"), "name").otherwise("phone")


def _address(surface: Column) -> Column:
    return F.regexp_extract(surface, rf"^({MEN}|{WOMEN}|{EITHER})\x20", 1)


def atoms_of(surface: Column) -> Column:
    """The entity's atoms (kind, norm)."""
    kind = kind_of(surface)
    gender = F.when(surface.rlike(rf"^(?:{WOMEN})\x20"), "name_f").when(surface.rlike(rf"^(?:{MEN})\x20"), "name_m").otherwise("name_u")
    names = F.split(F.regexp_replace(surface, rf"^(?:{MEN}|{WOMEN}|{EITHER})\x20", ""), r"[\x20-]")
    pair = lambda k, v: F.struct(k.cast("string").alias("kind"), v.alias("norm"))
    # the last of a person's names is the surname, which has no gender
    named = F.transform(names, lambda n, i: pair(F.when((i == F.size(names) - 1) & (F.size(names) > 1), F.lit("surname")).otherwise(F.when(F.size(names) > 1, gender).otherwise(F.lit("surname"))), n))
    digits = F.regexp_replace(surface, r"\D", "")
    code = F.regexp_extract(surface, r"^\+(\d{1,3})[ .(-]", 1)
    plain = F.when(kind == "email", F.lower(surface)).when(kind == "ip", surface).when(kind == "phone", F.concat(F.length(code).cast("string"), F.lit(":"), digits)).otherwise(digits)
    return F.when(kind == "name", named).otherwise(F.array(pair(kind, plain)))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body has it."""
    return F.transform(F.array(value), body)[0]


def _draw(stream: Column, i: Column, n: int) -> Column:
    """A number below n from the i-th (from 0) two bytes of a hexadecimal stream, which is used in a circle."""
    return (F.conv(stream.substr(i * 4 % 252 + 1, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.lit(letters).substr(n + 1, F.lit(1))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: (digits.substr(i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: (a + F.when(x > 9, x - 9).otherwise(x)).cast("int")) % 10


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """An atom's surrogate: a function of the key, the atom and the number of the attempt alone."""
    h = lambda *more: F.concat(*[F.sha2(F.concat_ws("\u001f", F.lit(key), *more, F.lit(str(i))), 256) for i in range(4)])
    host_stream = lambda host: h(F.lit("domain"), host)
    return _let(h(kind, norm, attempt.cast("string")), lambda stream: _from_stream(kind, norm, attempt, stream, host_stream))


def _from_stream(kind: Column, norm: Column, attempt: Column, stream: Column, host_stream) -> Column:
    """An atom's surrogate from its stream; a host's letters come from a stream of its own."""
    # numbers: free digits after those that are kept
    number = F.when(kind == "phone", F.substring_index(norm, ":", -1)).otherwise(norm)
    fixed = F.when(kind == "phone", F.substring_index(norm, ":", 1).cast("int")).when(kind == "card", F.lit(1)).otherwise(F.lit(0))
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), lambda i: F.when(i <= fixed, number.substr(i, F.lit(1))).otherwise(_draw(stream, i, 10).cast("string"))), "")
    short = digits.substr(F.lit(1), F.length(digits) - 1)
    last = (_luhn(number) - _luhn(F.concat(short, F.lit("0"))) + 10) % 10
    card = F.concat(short, last.cast("string"))
    octets = F.split(norm, r"\.")
    private = octets[0].isin("10", "127", "192", "172")
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when((i == 1) & private, octets[0]).otherwise((_draw(stream, i, 223) + 1).cast("string"))), ".")

    def like(text: Column, from_: Column, base: int = 0) -> Column:
        """text with other letters and digits in the same places."""
        chars = F.split(text, "")
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", _draw(from_, i + base, 26))).when(c.rlike("[0-9]"), _draw(from_, i + base, 10).cast("string")).otherwise(c)), "")

    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = domain.substr(F.lit(1), F.length(domain) - F.length(top) - 1)
    # after four attempts, further letters, so that the values do not run out
    more = F.floor(attempt / 4).cast("int")
    tail = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: _pick("abcdefghijklmnopqrstuvwxyz", _draw(stream, i + 40, 26))), "")).otherwise("")
    email = F.concat(like(local, stream), tail, F.lit("@"), _let(host_stream(host), lambda own: like(host, own)), F.lit("."), top)
    size = F.greatest(F.length(norm), F.lit(2)) + F.floor(attempt / 4).cast("int")
    cyrillic = norm.rlike(r"\p{IsCyrillic}")

    def spelt(consonants: str, vowels: str, female: str, male: str) -> Column:
        body = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i % 2 == 1, _pick(consonants, _draw(stream, i, len(consonants)))).otherwise(_pick(vowels, _draw(stream, i, len(vowels)))))
        word = F.array_join(body, "")
        ending = F.when(kind == "name_f", female).when(kind == "name_m", male)
        return F.initcap(F.when(ending.isNotNull(), F.concat(word.substr(F.lit(1), size - 1), ending)).otherwise(word))

    name = F.when(cyrillic, spelt(_CYR_CONSONANTS, _CYR_VOWELS, "а", "н")).otherwise(spelt(_CONSONANTS, _VOWELS, "a", "o"))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind.isin("phone", "ssn"), digits).otherwise(name)


def free_values(pending: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """pending numbers with a surrogate each that is not among taken (family, surrogate), by rank among the free values of their form.

    Of the first p + t values of a form, t of them taken at most, p are free.
    """
    number = F.when(F.col("kind") == "phone", F.col("plain")).otherwise(F.col("norm"))
    octet = F.substring_index("norm", ".", 1)
    fixed = F.when(F.col("kind") == "phone", number.substr(F.lit(1), F.substring_index("norm", ":", 1).cast("int")))
    fixed = fixed.when(F.col("kind") == "card", number.substr(1, 1)).when((F.col("kind") == "ip") & octet.isin("10", "127", "192", "172"), F.concat(octet, F.lit("."))).otherwise("")
    check = F.when(F.col("kind") == "card", _luhn(number)).otherwise(F.lit(-1))
    form = ["family", "fixed", "digits", "check"]
    p = pending.withColumns({"fixed": fixed, "digits": F.when(F.col("kind") == "ip", 0).otherwise(F.length(number)), "check": check})
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy(*form).orderBy(F.sha2(F.concat_ws("\u001f", F.lit(key), "kind", "norm"), 256), "norm")))
    forms = p.groupBy(*form).agg(F.count("*").alias("p"))
    near = forms.join(taken.distinct(), "family").where(F.col("surrogate").startswith(F.col("fixed")) & ((F.col("digits") == 0) | (F.length("surrogate") == F.col("digits"))))
    forms = forms.join(near.groupBy(*form).agg(F.count("*").alias("t")), form, "left")
    places = F.when(F.col("family") == "ip", F.when(F.col("fixed") == "", 4).otherwise(3)).otherwise(F.least(F.col("digits") - F.length("fixed") - (F.col("check") >= 0).cast("int"), F.lit(15)))
    space = F.pow(F.when(F.col("family") == "ip", 223).otherwise(10), places).cast("long")
    values = forms.withColumn("places", places).withColumn("space", space).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("p") + F.coalesce("t", F.lit(0)), F.col("space")) - 1)))
    # a keyed beginning, so that the values do not begin at 0 for every form
    first = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", F.lit(key), *form), 256), 1, 12), 16, 10).cast("long")
    value = (F.col("i") + first) % F.col("space")
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.col("places").cast("int")), lambda k: (F.floor(value / F.pow(F.lit(223), k - 1)).cast("long") % 223 + 1).cast("string")), ".")
    free = F.col("digits") - F.length("fixed") - (F.col("check") >= 0).cast("int")
    plain = F.concat("fixed", F.lpad(value.cast("string"), free, "0"))
    plain = F.when(F.col("check") < 0, plain).otherwise(F.concat(plain, ((F.col("check") - _luhn(F.concat(plain, F.lit("0"))) + 10) % 10).cast("string")))
    values = values.withColumn("surrogate", F.when(F.col("family") == "ip", F.concat("fixed", octets)).otherwise(plain))
    values = values.join(taken, ["family", "surrogate"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy(*form).orderBy("i")))
    return p.join(values.select(*form, "rank", "surrogate"), [*form, "rank"]).select(*pending.columns, "surrogate")


def assign(atoms: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of distinct atoms (kind, norm), surrogates distinct within a family and from all originals."""
    family = F.when(F.col("kind").rlike("name"), "name").otherwise(F.col("kind"))
    bare = lambda c: F.when(F.col("kind") == "phone", F.substring_index(c, ":", -1)).otherwise(F.col(c) if isinstance(c, str) else c)
    atoms = written(atoms.select("kind", "norm", family.alias("family"), bare("norm").alias("plain")), "atoms")
    originals = atoms.select("family", F.col("plain").alias("surrogate")).distinct()
    pending, settled = atoms.withColumn("attempt", F.lit(0)), None
    n = 0
    while True:
        drawn = pending
        if n >= ROUNDS:
            # names and addresses grow from round to round; numbers cannot
            drawn = pending.where(F.col("family").isin("name", "email"))
        drawn = drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.lit(n), key))
        if n >= ROUNDS:
            taken = originals.unionByName(settled.select("family", "surrogate"))
            drawn = drawn.unionByName(free_values(pending.where(~F.col("family").isin("name", "email")), taken, key), allowMissingColumns=True)
        keeps = drawn.groupBy("family", "surrogate").agg(F.min(F.struct("norm", "kind")).alias("first"))
        keeps = keeps.join(originals, ["family", "surrogate"], "left_anti")
        if settled is not None:
            keeps = keeps.join(settled.select("family", "surrogate"), ["family", "surrogate"], "left_anti")
        won = keeps.select("family", "surrogate", F.col("first.norm").alias("norm"), F.col("first.kind").alias("kind"))
        settled = written(won if settled is None else settled.unionByName(won), "settled")
        left = written(atoms.join(settled, ["kind", "norm"], "left_anti").withColumn("attempt", F.lit(n + 1)), "pending")
        if left.isEmpty():
            return settled.select("kind", "norm", "surrogate")
        numbers = ~F.col("family").isin("name", "email")
        if n >= ROUNDS and not left.where(numbers).isEmpty() and left.where(numbers).count() == pending.where(numbers).count():
            raise RuntimeError("a form of number has fewer values than there are originals and surrogates to tell apart")
        pending, n = left, n + 1


def _tag(kind: Column, norm: Column) -> Column:
    return F.concat(kind, F.lit("\u001f"), norm)


def rewritten(surface: Column, known: Column) -> Column:
    """An entity with its atoms' surrogates put into its own format."""
    atoms = atoms_of(surface)
    kind = kind_of(surface)
    got = F.transform(atoms, lambda a: F.element_at(known, _tag(a.kind, a.norm)))
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(st: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.when(digit, st.i + 1).otherwise(st.i).alias("i"), F.concat(st.out, F.when(digit, got[0].substr(st.i, F.lit(1))).otherwise(c)).alias("out"))

    spread = F.aggregate(F.split(surface, ""), start, step, lambda st: st.out)
    gap = F.when(surface.rlike(r"\p{Ll}-\p{Lu}"), "-").otherwise(" ")
    person = F.concat(_address(surface), F.lit(" "), got[0], F.when(F.size(got) > 1, F.concat(gap, got[1])).otherwise(""))
    return F.when(kind.isin("email", "ip"), got[0]).when(kind == "name", person).otherwise(spread)


def name_in(names: Column, word: Column) -> Column:
    """The surrogate of a word that is one of names (norm, second, kind, surrogate), or null."""
    same = F.get(F.filter(names, lambda n: n.norm == word), F.lit(0)).surrogate
    capitals = F.get(F.filter(names, lambda n: F.upper(n.norm) == word), F.lit(0)).surrogate
    return F.coalesce(same, F.upper(capitals))


def _mentions(part: Column, names: Column) -> Column:
    """part in words and what is between them, if it holds a name; null otherwise."""
    held = F.exists(names, lambda n: part.contains(n.norm) | part.contains(F.upper(n.norm)))
    return F.when(held, F.regexp_extract_all(part, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"), F.lit(0)))


def replace_entities(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """docs with entities replaced in text, and n_entities, their number, in the place of a column of that name."""
    docs = without(docs, "n_entities")
    names = docs.columns
    others = [c for c in names if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    packed = docs.select(row.alias("row"), F.col(f"`{text}`").alias("body"))
    hinted = F.coalesce(F.col("body").rlike(HINT), F.lit(False))
    # the entities alone, once for each text
    found = F.regexp_extract_all("body", F.lit(ANY), F.lit(0))
    texts = packed.where(hinted).select(F.sha2("body", 256).alias("key"), F.array_distinct(found).alias("found")).where(F.size("found") > 0)
    texts = texts.groupBy("key").agg(F.first("found").alias("found"))
    tags = written(texts.select("key", F.explode("found").alias("s")).select("key", F.inline(atoms_of(F.col("s")))).distinct(), "entities")
    table = assign(tags.select("kind", "norm").distinct(), key)
    # a name alone is taken for a surname first
    person = F.when(F.col("kind").rlike("name"), F.struct("norm", (F.col("kind") != "surname").alias("second"), "kind", "surrogate"))
    known = tags.join(table, ["kind", "norm"]).groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct(_tag(F.col("kind"), F.col("norm")), "surrogate"))).alias("known"),
        F.array_sort(F.collect_list(person)).alias("names"),
    )
    new = packed.where(hinted).withColumn("key", F.sha2("body", 256)).join(known, "key", "left")
    some = F.col("known").isNotNull()
    new = new.withColumn("parts", F.when(some, F.split("body", ANY, -1))).withColumn("with", F.when(some, F.transform(found, lambda s: rewritten(s, F.col("known")))))
    # each part between entities: its text, and how many names stand in it
    words = F.transform("parts", lambda p: F.struct(p.alias("part"), _mentions(p, F.col("names")).alias("words")))
    named = F.transform("words", lambda p: F.struct(p.part.alias("part"), p.words.alias("words"), F.transform(p.words, lambda w: name_in(F.col("names"), w)).alias("by")))
    told = F.transform("named", lambda p: F.struct(F.when(p.by.isNull(), p.part).otherwise(F.array_join(F.zip_with(p.words, p.by, lambda w, b: F.coalesce(b, w)), "")).alias("part"), F.coalesce(F.size(F.filter(p.by, lambda b: b.isNotNull())), F.lit(0)).alias("n")))
    new = new.withColumn("words", words).withColumn("named", named).withColumn("told", told)
    new = new.withColumn("parts", F.col("told.part")).withColumn("more", F.aggregate("told", F.lit(0), lambda a, p: a + F.greatest(p.n, F.lit(0))))
    joined = F.concat(F.array_join(F.zip_with(F.slice("parts", F.lit(1), F.size("with")), "with", lambda p, w: F.concat(p, w)), ""), F.element_at("parts", -1))
    new = new.select("row", F.when(some, joined).otherwise(F.col("body")).alias("body"), F.when(some, F.size("with") + F.col("more")).otherwise(0).cast("long").alias("n_entities"))
    out = packed.where(~hinted).select("row", "body", F.lit(0).cast("long").alias("n_entities")).unionByName(new)
    return out.select(*[(F.col("body") if c == text else F.col("row")[c]).alias(c) for c in names], "n_entities")


def op3_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, key="surrogate-key-1").select("doc_id", "n_entities", "text")
