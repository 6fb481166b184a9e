import hashlib
import re

import pytest
from pyspark.sql import functions as F

from logmill.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "no data", "a@b.c", "mail: x.y+z@ex-ample.co.uk!", "a@b.c_d@e.f", "a@b.c@d.e.f", "@@a@b..c", "é😀 a@b.co 10.0.0.1 😀 +1 (310) 555-4510",
    "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.256 001.002.003.0004", "4111 1111 1111 1111", "4111-1111-1111-1111 x 4111111111111112", "41111111111111114111 1", "12 4111111111111111",
    "+12", "+1 2345678", "+1234567890123456", "++1 (22) 333-44-55- x", "+1 .......", "5500005555555559 5500005555555559", "a" * 3000, "1." * 3000, "1 " * 3000, "x@" + "a." * 3000 + "b", "+1" * 500,
    " ".join(f"u{i}@h{i}.org" for i in range(700)),
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("spans", F.lit(7))
    for r in pii.find_personal_data(df).collect():
        got = [(s.kind, s.start, s.end) for s in r.spans if s.kind in PATTERNS]
        assert got == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert all((TEXTS[r.doc_id] or "")[s.start : s.end] == s.text for s in r.spans)


@pytest.mark.parametrize("text, kinds", [("IBAN DE89 3704 0044 0532 0130 00 paid", ["iban"]), ("DE88 3704 0044 0532 0130 00", []), ("my SSN is 123-45-6789", ["ssn"]), ("part 123-45-6789", []), ("GB82WEST12345698765432", ["iban"]), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', ["secret"]), ("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", []), ("password: correct-horse-battery", []), ("API_KEY=sk-a1b2c3d4e5f6g7h8i9j0", ["secret"]), ("token " + "a1" * 200, [])])
def test_checksums_and_context(spark, text, kinds):
    (r,) = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [s.kind for s in r.spans] == kinds


def test_query_and_redaction(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.c and 10.0.0.1"), (1, "a@b.c and 10.0.0.1"), (None, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = pii.query(spark, str(tmp_path)).collect()
    assert len(rows) == 3
    r = next(r for r in rows if r.doc_id)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 1, 0, 0, "email:0:5,ip:10:18")
    assert (r.n_iban, r.n_secret, r.n_ssn, r.n_spans, r.score) == (0, 0, 0, 2, 0.9)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert next(r for r in rows if r.doc_id is None).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.redacted for r in pii.redact(df).collect()} == {"<email> and <ip>", ""}
    assert pii.find_personal_data(df.limit(0)).count() == 0
