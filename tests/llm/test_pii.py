import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pii_boost as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


CASES = [None, "", "é a.b@c.d.e, x@y, +1 (743) 555-3824. 001.2.3.255 1.2.3.256 4.3.2.1.5.6.7.8", "4111 1111-1111 1111 4111111111111111 4111  1111", "a@b.c+d@e.f@g.h a%@-.-", "+" + "1" * 15 + " +12 +1-2-3-4-5-6-7-8-9..", "1" * 500 + " " + "1 " * 3000 + "a" * 50000 + "@" + "b." * 3000]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(2)
    texts = CASES + ["".join(rng.choices("019+. ()-@aé", k=rng.randrange(1, 90))) for _ in range(1500)] + [" ".join(f"u{i}@ex.org" for i in range(700))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    return texts, P.find_personal_data(docs).orderBy("doc_id").collect()


def test_rules_match_brute_force(found):
    texts, rows = found
    for t, r in zip(texts, rows, strict=True):
        assert [(s.start, s.no, s.end) for s in r.base] == brute(t), t
        assert {(s.start, s.no) for s in r.base} <= {(s.start, s.no) for s in r.spans}


def test_model(spark):
    docs = spark.createDataFrame([(0, 'say token = "1eb9c654e721b4f812088970e66a6345cee33dd6" and'), (1, "my SSN 123-45-6789 here"), (2, "Thntblere of then, edtioner in inea that esly. On 2024-05-17 it ndstnd 1990-2005 of."), (3, "mail me at bob (at) example (dot) com now")], "doc_id long, text string")
    rows = P.find_personal_data(docs)
    kinds = [[s.kind for s in r.spans] for r in rows.orderBy("doc_id").collect()]
    assert kinds == [["secret"], ["number"], [], ["handle"]]
    assert P.redact(rows).orderBy("doc_id").first().text == 'say token = "[secret]" and'
    assert rows.where(F.lit(False)).count() == 0


def test_held_out_snippets(spark):
    model = P._trained(spark)
    assert all(0.5 <= t <= 0.95 for t in model.thresholds)


def test_long_keys_are_found_whole(spark):
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key = "".join(rng.choices(letters + "0123456789+/", k=600))
    late = "".join(rng.choices(letters, k=70)) + "".join(rng.choices(letters + "0123456789", k=50))
    docs = spark.createDataFrame([(i, f'say token = "{k}" and') for i, k in enumerate((key, late))], "doc_id long, text string")
    rows = P.find_personal_data(docs)
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in rows.orderBy("doc_id").collect()] == [[("secret", 13, 13 + len(k))] for k in (key, late)]
    assert {r.text for r in P.redact(rows).collect()} == {'say token = "[secret]" and'}


def test_written_addresses_of_any_length(spark):
    text = "n" * 300 + " (at) " + "d" * 200 + " (dot) " + "c" * 40
    df = spark.createDataFrame([("mail " + text + " now",)], "_t string")
    found = P._located(df, ["handle"]).first()["_s_handle"]
    assert [(m.start, m.match) for m in found] == [(5, text)]
