import hashlib
import re

from sketchloom.llm import pii

DOCS = "doc_id long, text string, source string, pii string"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]
TEXTS = [
    None,
    "",
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +1 555 1234567 9 4111-1111 1111-1111",
    "256.1.1.1 001.02.3.4 300.300.300.300.1.2.3.4 0000.0.0.255",
    "\U0001f600 é x@y.zz 1.1.1.1\n2.2.2.2 4111111111111111 4111111111111112",
    "1.2.3.4 " * 700,
    "card 4111 1111 1111 1111 4111 1111 1111 1111",
    "+1 (743) 555-3824 +12 +123456789012345678",
    "9" * 50_000 + " " + "a" * 100_000 + "@",
    "x@y x@y. @y.z x@-.-",
]


def brute(text):
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m.group()))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)


def test_base_spans_against_a_plain_scan(spark):
    rows = [(i, t, "s", "clash") for i, t in enumerate(TEXTS) if i != 8]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, *_ in rows:
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, got[i].spans, want)
        assert [got[i][f"n_{k}"] for k, *_ in BASE] == [len(re.findall(rf"(?:^|,){k}:", want)) for k, *_ in BASE]


def test_long_runs_and_empty_table(spark):
    got = pii.digest(spark.createDataFrame([(8, TEXTS[8], "s", "x")], DOCS)).first()
    assert got.spans == ""
    assert pii.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_checksums_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE88 3704 0044 0532 0130 00.", "social security 123-45-6789", "model 123-45-6789", "ssn 000-45-6789"]
    got = [r.spans for r in pii.digest(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "", "ssn:16:27", "", ""]


def test_columns_pass_and_redaction(spark):
    df = spark.createDataFrame([(1, "mail é a@b.cd or 1.1.1.1!", "s", "old"), (2, None, "s", "old")], DOCS)
    found = pii.find(df)
    assert found.columns == ["doc_id", "text", "source", "pii"]
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["mail é [EMAIL] or [IP]!", None]


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "s", "old")], DOCS).selectExpr("*", "1 AS _body", "2 AS BODY", "3 AS hit_ip", "4 AS whole", "5 AS _whole", "6 AS spans")
    found = pii.find(df, out="PII")
    assert found.columns == [*(c for c in df.columns if c != "pii"), "PII"] and len(found.first()["PII"]) == 1
    done = pii.redact(df)
    assert done.columns == df.columns and tuple(done.first()) == (1, "[EMAIL]", "s", "old", 1, 2, 3, 4, 5, 6)
