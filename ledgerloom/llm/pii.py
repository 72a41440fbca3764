"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern, and a surname that a document has beside a title or given name also where it stands alone there; each gets a canonical form (digits of a number, lower case of an address), so that
all spellings of one entity share one surrogate everywhere in the corpus. A surrogate replaces the canonical form symbol by
symbol, from a keyed digest of kind and form: digits by digits, vowels by vowels, consonants by consonants of the same
script, a given name by a given name of the same gender and script; written forms then keep their own punctuation,
spacing and case. A phone number keeps its country code, an IBAN its country; card numbers and IBANs whose check digits are right get
right ones. Surrogates are checked against each other and against all detected entities: in rounds, whatever
meets another is drawn anew, so different entities stay different; after every eight rounds a symbol is added, so that forms too short for so
many entities part as well.

The pattern takes time in proportion to the text, however long its words are: what may repeat does so without steps back or up to a bound, and the
part for addresses is only tried where a text has an @.

Only rows that hold an entity are shuffled: their matches to the table of entities and the answers back to the rows.
The joins are plain sort-merge joins, which the engine splits where one entity fills many rows.

Cases: null and empty texts stay as they are; repeated rows get the same answer each; a null id is kept; an empty table
gives an empty result; columns named in keep are carried, others are left behind. Ties (two forms with one surrogate) go to the smaller form.
Very long texts are read whole; of a secret of more than 512 symbols the first 512 are exchanged and the others left out.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, stored

#: Given names by script and gender; a name is exchanged inside its own list.
GIVEN = {
    "latin_f": "Anna Maria Julia Laura Sophie Emma Hannah Clara Martina Sandra Claudia Isabelle Camille Chloe Manon Lucia Carmen Elena Teresa Alice Emily Olivia Sarah Jessica Jennifer Elizabeth Margaret Charlotte",
    "latin_m": "Thomas Michael Stefan Andreas Markus Johannes Lukas Felix Pierre Antoine Nicolas Julien Mathieu Carlos Miguel Javier Antonio Manuel William James Robert Richard Charles George Edward Daniel Benjamin Christopher",
    "cyrillic_f": "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Юлия",
    "cyrillic_m": "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел",
}
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|Mister"
#: Marks that noisy texts put between the parts of a number.
GAP = r"[ .\-!*$&%#]{0,5}"

SURNAME = r"(?:\p{Lu}['’])?\p{Lu}\p{L}{1,60}(?!\p{L})(?:['’-]\p{L}{2,60}(?!\p{L})){0,3}"
#: After a given name alone, two letters are too often another word.
LONG_SURNAME = r"(?=['’\p{L}]{3})" + SURNAME
_NAMES = "|".join(n for names in GIVEN.values() for n in names.split())
GIVEN_NAMES = rf"(?:(?:{_NAMES})[ -]){{0,3}}"
_LOCAL = r"[\p{L}\p{N}._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL}){_LOCAL}{{1,63}}+|{_LOCAL}{{64}}+)@[\p{{L}}\p{{N}}-][\p{{L}}\p{{N}}.-]{{0,250}}\.\p{{L}}{{2,63}}"
SECRET_WORDS = r"(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
MAX_SECRET = 512
#: Every kind begins with a sign of its own, which is looked for first.
PATTERNS = {
    "email": EMAIL,
    "secret": rf"(?=A)\bAKIA[0-9A-Z]{{16}}\b|(?=[pPsStTaA])(?i:{SECRET_WORDS}[0-9a-z+/_-]{{12,}}+)",
    "iban": r"(?=[A-Z]{2}\d)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": rf"\+\d{{1,3}}{GAP}\(?\d{{2,4}}\)?{GAP}\d{{3,4}}{GAP}\d{{3,4}}(?!\d)|\(\d{{3}}\){GAP}\d{{3}}{GAP}\d{{4}}(?!\d)"
    r"|(?=\d)(?<![\d.,+-])(?:\d{3}([-.])\d{3}\1\d{4}|0\d{2,4}[ /-]\d{5,8})(?![\d,]|[.-]\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<!\d)(?:\d{4}[ -]?){3}\d{1,7}(?!\d)",
    "person": rf"(?=\p{{Lu}})\b(?:(?:{TITLES})\.? {GIVEN_NAMES}{SURNAME}|(?:(?:{_NAMES})[ -]){{1,3}}{LONG_SURNAME})",
}
WITHOUT_EMAIL = r"(?=[\p{Lu}\d+(pPsStTaA])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email") + ")"
ANY = f"(?:{EMAIL})|{WITHOUT_EMAIL}"
#: Calling codes of one and two digits; all others have three.
CALLING_CODE = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ALPHABETS = {  # consonants and vowels of each script, lower case
    "latin": ("bcdfghjklmnpqrstvwxz", "aeiouy"),
    "cyrillic": ("бвгджзклмнпрстфхцчшщ", "аеиоуыэюя"),
    "greek": ("βγδζθκλμνξπρστφχψ", "αεηιου"),
}
VOWELS = "aeiouyäöüàáâãåæèéêëìíîïòóôõùúûýœаеёиоуыэюяαεηιουωάέήίόύώ"
#: Rounds of drawing after which a symbol is added.
LONGER = 8


def kind_of(value: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("person")


def secret_value(value: Column) -> Column:
    """A secret without the word that announces it, and without what is beyond the symbols that are exchanged."""
    return F.substring(F.regexp_extract(value, rf"(?i)^({SECRET_WORDS})?(.*)$", 2), 1, MAX_SECRET)


def secret_form(value: Column) -> Column:
    """A secret in lower case; where it is too long, a digest of the whole stands for the rest."""
    whole = F.lower(F.regexp_replace(value, rf"(?i)^{SECRET_WORDS}", ""))
    return F.when(F.length(whole) <= MAX_SECRET, whole).otherwise(F.concat(F.substring(whole, 1, MAX_SECRET - 64), F.sha2(whole, 256)))


def person_part(value: Column, which: int) -> Column:
    """Title (1), given names (2) or surname (3) of a person."""
    return F.regexp_extract(value, rf"^((?:{TITLES})\.? )?({GIVEN_NAMES})(.+)$", which)


def surnames(matches: Column) -> Column:
    """The different surnames, longest first, of the persons among the matches."""
    found = F.array_distinct(F.transform(F.filter(matches, lambda m: kind_of(m) == "person"), lambda m: person_part(m, 3)))
    return F.transform(F.sort_array(F.transform(found, lambda n: F.struct(F.length(n).alias("l"), n.alias("n"))), asc=False), lambda x: x["n"])


def parts(matches: Column) -> Column:
    """Kind and canonical form of every match. A person's is the surname; given names are exchanged inside their own lists."""

    def of(value: Column) -> Column:
        kind = kind_of(value)
        whole = (
            F.when((kind == "phone") & value.startswith("+"), F.regexp_replace(value, r"[^\d+]", ""))
            .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", ""))
            .when(kind == "iban", F.regexp_replace(value, " ", ""))
            .when(kind == "secret", secret_form(value))
            .when(kind == "person", F.lower(person_part(value, 3)))
            .otherwise(F.lower(value))
        )
        return F.array(F.struct(kind.alias("kind"), whole.alias("form")))

    return F.flatten(F.transform(matches, of))


def drawn(seed: Column, i: Column) -> Column:
    """A keyed number from 0 to 65535 for the i-th symbol (from 0)."""
    digest = F.sha2(F.concat_ws("|", seed, F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substring(digest, 1 + F.pmod(i, F.lit(16)) * 4, F.lit(4)), 16, 10).cast("int")


def letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), 1 + F.pmod(n, F.lit(len(alphabet))), F.lit(1))


def respelled(form: Column, seed: Column, letters: str) -> Column:
    """The form with every digit and letter exchanged for one of its own sort; the rest stands. Which letters are exchanged:
    hex (0-9 and a-f among themselves), plain or upper."""

    def symbol(c: Column, i: Column) -> Column:
        n = drawn(seed, i)
        if letters == "hex":
            return F.when(c.rlike("[0-9a-f]"), letter("0123456789abcdef", n)).when(c.rlike("[g-z]"), letter("ghijkmnpqrstuvwxyz", n)).otherwise(c)
        out = F.when(c.rlike("[0-9]"), letter("0123456789", n))
        for script, (consonants, vowels) in (("Cyrillic", ALPHABETS["cyrillic"]), ("Greek", ALPHABETS["greek"]), ("", ALPHABETS["latin"])):
            inside = c.rlike(rf"\p{{Is{script}}}") if script else c.rlike(r"\p{L}")
            out = out.when(inside & c.rlike(f"[{VOWELS}]"), letter(vowels, n)).when(inside, letter(consonants, n))
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(form, ""), lambda c: c != ""), symbol), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last of which counts singly."""
    backward = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(backward, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def iban_rest(country: Column, body: Column) -> Column:
    """What is left when an account number with zeros for its check digits is divided by 97."""
    symbols = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    return F.aggregate(symbols, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    seed = F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string"))
    plain = respelled(form, seed, "plain")
    last = F.length(form)
    body = F.concat(F.substring(plain, F.lit(1), last - 1), F.lit("0"))
    valid = F.concat(F.substring(plain, F.lit(1), last - 1), F.pmod(F.lit(10) - luhn_sum(body) % 10, F.lit(10)).cast("string"))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + F.pmod(drawn(seed, i), F.lit(254))).cast("string")), ".")
    domain = F.regexp_extract(form, r"(\.[^.@]*)$", 1)
    address = F.concat(respelled(F.substring(form, F.lit(1), F.length(form) - F.length(domain)), seed, "plain"), domain)
    # A phone keeps its country code or its leading zero, an IBAN its country, a Cyrillic surname the ending that shows its gender.
    keeps = F.when(kind == "phone", F.length(F.regexp_extract(form, rf"{CALLING_CODE}|^0", 0))).otherwise(0)
    country, account = F.substring(form, F.lit(1), F.lit(2)), F.upper(respelled(F.lower(F.substring(form, F.lit(5), F.length(form))), seed, "plain"))
    was_right = (iban_rest(country, F.substring(form, F.lit(5), F.length(form))) + F.substring(form, F.lit(3), F.lit(2)).cast("int")) % 97 == 1
    check = F.when(was_right, F.lpad((98 - iban_rest(country, account)).cast("string"), 2, "0")).otherwise(F.substring(plain, F.lit(3), F.lit(2)))
    headed = F.concat(F.substring(form, F.lit(1), keeps), F.substring(plain, keeps + 1, F.length(form)))
    ending = F.when(form.rlike(r"\p{IsCyrillic}(ова|ева|ина|ая)$"), F.regexp_extract(form, r"(ова|ева|ина|ая)$", 1)).otherwise("")
    surname = F.concat(F.substring(plain, F.lit(1), F.length(plain) - F.length(ending)), ending)
    key_id = F.concat(F.substring(form, F.lit(1), F.lit(4)), respelled(F.substring(form, F.lit(5), F.length(form)), seed, "plain"))
    out = (
        F.when(kind == "email", address)
        .when(kind == "ip", octets)
        .when((kind == "card") & (luhn_sum(form) % 10 == 0), valid)
        .when((kind == "secret") & form.rlike("^akia[0-9a-z]{16}$"), key_id)
        .when((kind == "secret") & form.rlike("^[0-9a-f]+$"), respelled(form, seed, "hex"))
        .when(kind == "person", surname)
        .when(kind == "iban", F.concat(country, check, account))
        .otherwise(headed)
    )
    # Where the forms of a length are used up, a longer one parts what is left.
    more = F.transform(F.sequence(F.lit(1), F.floor(attempt / LONGER).cast("int")), lambda i: F.when(form.rlike(r"\p{L}$"), letter("aeiou", drawn(seed, 7000 + i))).otherwise(letter("0123456789", drawn(seed, 7000 + i))))
    return F.when(attempt < LONGER, out).when(kind == "email", F.concat(F.array_join(more, ""), out)).otherwise(F.concat(out, F.array_join(more, "")))


def entity_table(found: DataFrame, key: str) -> DataFrame:
    """kind, form, surrogate for each distinct entity in the array column parts: distinct, and none of them an entity itself."""
    entities = found.select(F.explode("parts").alias("p")).select("p.kind", "p.form").distinct()
    table = stored(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.lit(0), key)), "pii_round")
    for turn in itertools.count(1):
        first = Window.partitionBy("kind", "surrogate").orderBy("form")
        real = table.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("taken"))
        checked = table.withColumn("turn", F.row_number().over(first)).join(real, ["kind", "surrogate"], "left")
        again = (F.col("turn") > 1) | F.coalesce("taken", F.lit(False))
        if checked.where(again).isEmpty():
            return table.select("kind", "form", "surrogate")
        fresh = surrogate(F.col("kind"), F.col("form"), F.lit(turn), key)
        table = stored(
            checked.select("kind", "form", F.when(again, turn).otherwise(F.col("attempt")).alias("attempt"), F.when(again, fresh).otherwise(F.col("surrogate")).alias("surrogate")),
            "pii_round",
        )


def given_name(name: Column, key: str) -> Column:
    """The name that follows in its own list, in an order that the key gives: distinct names stay distinct."""
    out = name
    for group, names in GIVEN.items():
        order = F.array_sort(F.transform(F.array(*map(F.lit, names.split())), lambda n: F.struct(F.sha2(F.concat_ws("|", F.lit(key), F.lit(group), n), 256).alias("h"), n.alias("n"))))
        ordered = F.transform(order, lambda s: s["n"])
        at = F.array_position(ordered, name)
        out = F.when(at > 0, F.element_at(ordered, (F.pmod(at, F.lit(len(names.split()))) + 1).cast("int"))).otherwise(out)
    return out


def dressed(written: Column, new: Column) -> Column:
    """The new symbols in the spaces, punctuation and case of the written form: its letters and digits are replaced in order, and what is left of
    a longer surrogate follows."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def step(acc: Column, c: Column) -> Column:
        fresh = F.substring(new, acc["used"] + 1, F.lit(1))
        cased = F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(fresh)).otherwise(fresh)
        moves = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc["text"], F.when(moves, cased).otherwise(c)).alias("text"), (acc["used"] + F.when(moves, 1).otherwise(0)).alias("used"))

    return F.aggregate(
        F.filter(F.split(written, ""), lambda c: c != ""), start, step, lambda acc: F.concat(acc["text"], F.substring(new, acc["used"] + 1, F.length(new)))
    )


def replacement(value: Column, kind: Column, new: Column, key: str) -> Column:
    """What stands in the text for a match whose main part has this surrogate."""
    symbols = F.regexp_replace(new, r"[^\p{L}\p{N}]", "")
    secret = secret_value(value)
    intro = F.regexp_extract(value, rf"(?i)^({SECRET_WORDS})?", 0)
    # Given names and what stands after each of them.
    given = F.transform(F.regexp_extract_all(person_part(value, 2), F.lit(r"[^ -]+[ -]"), F.lit(0)), lambda g: F.concat(given_name(F.substring(g, F.lit(1), F.length(g) - 1), key), F.substring(g, F.length(g), F.lit(1))))
    named = F.concat(person_part(value, 1), F.array_join(given, ""), dressed(person_part(value, 3), symbols))
    longer = (kind == "email") & (F.length(new) > F.length(value))
    return F.when((kind == "ip") | longer, new).when(kind == "secret", F.concat(intro, dressed(secret, symbols))).when(kind == "person", named).otherwise(dressed(value, symbols))


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (and the columns in keep), the text with every entity exchanged, n_entities, and entities (array of kind, written)."""
    kept = [c for c in (keep or []) if c not in (id_col, text_col)]
    rows = columns(docs, **{id_col: id_col}, **{c: c for c in kept}, **{text_col: text_col})
    text = F.col(text_col)
    dirty = F.coalesce(F.when(text.contains("@"), text.rlike(ANY)).otherwise(text.rlike(WITHOUT_EMAIL)), F.lit(False))
    empty = F.array().cast("array<struct<kind: string, written: string>>")
    untouched = rows.where(~dirty).select("*", F.lit(0).cast("long").alias("n_entities"), empty.alias("entities"))
    # Where a document names persons, their surnames are entities wherever they stand in it.
    first = rows.where(dirty).select(F.col(id_col), *kept, text.alias("_text"), F.regexp_extract_all(text_col, F.lit(ANY), F.lit(0)).alias("matches"))
    named = first.withColumn("_names", surnames(F.col("matches"))).withColumn(
        "_pattern", F.when(F.size("_names") > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}'’-])(?:"), F.array_join("_names", "|"), F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ANY))
    )
    again = F.when(F.size("_names") > 0, F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0))).otherwise(F.col("matches"))
    found = stored(named.select(F.col(id_col), *kept, "_text", "_pattern", again.alias("matches")).select("*", parts(F.col("matches")).alias("parts")), "pii_found")
    table = entity_table(found, key)
    # Equal rows share one answer: they are numbered by content, so repeated rows are answered once and kept each.
    row = F.sha2(F.to_json(F.struct(F.col("_text"))), 256)
    asked = found.select(row.alias("_row"), "matches").dropDuplicates(["_row"]).select("_row", F.posexplode("matches").alias("pos", "written"))
    main = asked.select("_row", "pos", "written", parts(F.array("written"))[0].alias("p")).select("_row", "pos", "written", "p.kind", "p.form")
    answered = main.join(table, ["kind", "form"]).select(
        "_row", F.struct("pos", "kind", "written", replacement(F.col("written"), F.col("kind"), F.col("surrogate"), key).alias("new")).alias("m")
    )
    per_row = stored(answered.groupBy("_row").agg(F.array_sort(F.collect_list("m")).alias("ms")), "pii_answers")
    joined = found.withColumn("_row", row).join(per_row, "_row")
    gaps = F.split(F.col("_text"), F.col("_pattern"), -1)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("ms.new"), i), F.lit(""))))
    exchanged = joined.select(
        F.col(id_col),
        *kept,
        F.array_join(pieces, "").alias(text_col),
        F.size("ms").cast("long").alias("n_entities"),
        F.transform("ms", lambda m: F.struct(m["kind"].alias("kind"), m["written"].alias("written"))).alias("entities"),
    )
    return untouched.unionByName(exchanged)
