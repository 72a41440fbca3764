"""Forms of personal data, names that stand alone, long words, and more entities than spellings."""

import re
import time

from pyspark.sql import functions as F


def exchanged(spark, texts):
    from ledgerloom.llm.pii import surrogates

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in surrogates(docs, "key").collect()}


def right_iban(value):
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_forms(spark):
    texts = [
        "Anna Schmidt left. Schmidt came back, and Schmidt's car too; Schmidtchen stayed.", "Mr. Li and Frau O'Brien-Meyer. Li spoke. Anna Maria Weber, then Weber.",
        "call 030 1234567 or 555-123-4567 or +49 30 1234567 or +1 212 555 1234", "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "Dr. Anna Weber", "a 123-45-6789 b",
    ]
    got = exchanged(spark, texts)
    m = re.fullmatch(r"(\w+) (\w+) left\. (\w+) came back, and (\w+)'s car too; Schmidtchen stayed\.", got[0].text)
    assert m[2] == m[3] == m[4] != "Schmidt" and m[1] != "Anna"
    m = re.fullmatch(r"Mr\. (\w\w) and Frau (\w'\w+-\w+)\. (\w\w) spoke\. (\w+) (\w+) (\w+), then (\w+)\.", got[1].text)
    assert m[1] == m[3] != "Li" and m[2] != "O'Brien-Meyer" and m[6] == m[7] != "Weber" and (m[4], m[5]) != ("Anna", "Maria")
    m = re.fullmatch(r"call (0\d\d \d{7}) or (\d{3}-\d{3}-\d{4}) or (\+49 \d\d \d{7}) or (\+1 \d{3} \d{3} \d{4})", got[2].text)
    assert not {m[i] for i in range(1, 5)} & {"030 1234567", "555-123-4567", "+49 30 1234567", "+1 212 555 1234"}
    m = re.fullmatch(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (GB\d\d[A-Z]{4}\d{14})", got[3].text)
    assert right_iban(m[1]) and right_iban(m[2]) and m[1] not in texts[3] and m[2] not in texts[3]
    assert got[4].text.split()[2] == m_weber(got[1].text) and re.fullmatch(r"a \d{3}-\d\d-\d{4} b", got[5].text) and got[5].text != texts[5]


def m_weber(text):
    return re.search(r"then (\w+)\.", text)[1]


def test_long_words(spark):
    long = "q7" * 500_000
    texts = ["x@" + "a." * 20000 + "1", long, "a" * 1_000_000 + "@", long + "@mail.example.com", "token = " + "z9" * 50_000 + " end", "Mr. " + "Ab" * 20000, "Mr. A" + "-bb" * 20000, "1-" * 50_000, "Anna-" * 20000]
    began = time.perf_counter()
    got = exchanged(spark, texts)
    assert time.perf_counter() - began < 60
    assert got[1].text == long and got[2].text == texts[2] and got[3].text.startswith("q7" * 1000) and "@mail.example.com" not in got[3].text
    assert re.fullmatch(r"token = [a-z0-9]{512} end", got[4].text)


def test_more_entities_than_spellings(spark):
    letters = "bcdfghjkmnpqrstvwxz"
    names = [f"{a.upper()}{b}" for a in letters for b in letters]
    got = exchanged(spark, [f"Mr. {n} x" for n in names] + [f"{n}@{a}.de" for n in letters for a in letters])
    said = [r.text for r in got.values()]
    assert len(set(said)) == len(said) and not set(said) & ({f"Mr. {n} x" for n in names} | {f"{n}@{a}.de" for n in letters for a in letters})


def test_no_python_in_the_plan(spark):
    from ledgerloom.llm.pii import surrogates

    docs = spark.createDataFrame([(1, "mail a@b.de Mr. Smith")], "doc_id long, text string")
    plan = surrogates(docs.withColumn("n", F.lit(1)), "key")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
