from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from lateflow.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    odd, even = number[::-1][::2], number[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def brute(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(number) <= 19 and luhn(number)):
                continue
            if kind == "phone" and not 9 <= len(number) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def spans(text: str, base: bool | None = None) -> list[tuple[str, str]]:
    return [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text) if base is None or s.base == base]


def noise(r: random.Random) -> str:
    parts = ["a", "B7", "@", "@", ".", ".", "-", "_", " ", "\n", "é", "+", "+1", "(743)", "555", "1", "12", "255", "256", "007", "4785380592391139", "4111 1111-1111 1111", "[at]", "::", "DE89"]
    return "".join(r.choice(parts) for _ in range(r.randrange(0, 40)))


def test_base_spans_equal_the_patterns():
    r = random.Random(4)
    found = 0
    for _ in range(30_000):
        text = noise(r)
        got = [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.base]
        assert got == brute(text), text
        found += len(got)
    assert found > 5000


def test_validators():
    assert pii.luhn("4111 1111 1111 1111") and not pii.luhn("4111 1111 1111 1112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert pii.is_ssn("123-45-6789") and not any(map(pii.is_ssn, ("000-45-6789", "666-45-6789", "923-45-6789", "123-00-6789", "123-45-0000")))
    assert pii.ip_parts("007.0.255.1") and not pii.ip_parts("1.2.3.256") and not pii.ip_parts("1.2.3." + "9" * 5000)
    assert len(pii._LENGTH) == len(pii.IBAN_LENGTHS.split()) < 200


def test_added_spans():
    assert spans("pay to DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert spans("GB82WEST12345698765432, GB82WEST12345698765433 XGB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert spans("write to jo.doe [at] mail (dot) example.org today") == [("email", "jo.doe [at] mail (dot) example.org")]
    assert spans("host 2001:db8:0:0:1:0:0:1 and fe80::1ff:fe23:4567 at 12:30:45, std::vector, a::b") == [("ip", "2001:db8:0:0:1:0:0:1"), ("ip", "fe80::1ff:fe23:4567")]
    # words near by decide
    assert spans("SSN 123-45-6789") == [("ssn", "123-45-6789")] and spans("the number 123-45-6789") == []
    assert spans("my phone is (212) 555-0187.") == [("phone", "(212) 555-0187")] and spans("results 212 555 0187 here") == []
    assert spans("Visa 4111.1111.1111.1111") == [("card", "4111.1111.1111.1111")] and spans("order 4111.1111.1111.1111") == []
    assert spans("SSN order 123-45-6789") == []
    # base spans stay whatever stands near, and added ones give way to them
    assert spans("order ticket ref +1 (743) 555-3824") == [("phone", "+1 (743) 555-3824")]
    text = "call +1 212 555 0187 or a@b.example [at] c.example"
    assert spans(text, False) == [] and [k for k, _ in spans(text, True)] == ["email", "phone"]
    assert [s.score for s in pii.find_spans("mail a@b.cc")] == [1.0] and [s.score for s in pii.find_spans("version 1.2.3.4")] == [0.35]


def test_clean_prose_has_none():
    r = random.Random(1)
    words = ["call", "the", "Phone", "bank", "ISBN", "978-3-16-148410-0", "2024-05-17", "10:45", "3.14", "v1.2.3", "1,000", "12:30:45", "COVID19", "mail", "@home", "a+b", "100-200", "1999-2001", "EU2020", "ssn"]
    text = " ".join(r.choice(words) for _ in range(20_000))
    assert [s for s in spans(text) if s[0] not in ("card",)] == []


@pytest.mark.parametrize("piece", ["a", "1", "1.", "+1 ", "a@", ":", "12 ", "A1", "[at]", "a.b@c", "1-"])
def test_long_runs_take_linear_time(piece):
    times = []
    for n in (100_000, 400_000):
        began = time.process_time()
        pii.find_spans(piece * n)
        times.append(time.process_time() - began)
    assert times[1] < 8 * times[0] + 1.0


def test_query(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, noise(r) + r.choice(["", " mail x.y@z.example", " é +1 (743) 555-3824 4785380592391139", " IBAN DE89370400440532013000"]), "n") for i in range(300)]
    rows += [(1, None, "n"), (1, "", "n"), (None, "a@b.cc", "n"), (5, "y" * 4_000 + " a@b.cc " + "z y1 " * 60_000, "n"), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op11_pii(spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for i, text, _ in rows:
        base = brute(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want.append((i, *(sum(k == x[0] for x in base) for k in BASE), digest, base))
    got = [(*x[:6], x["spans"]) for x in out.collect()]
    key = lambda x: (x[0] is not None, x[:6])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:6] == b[:6]
        assert set(f"{k}:{p}:{q}" for k, p, q in b[6]) <= set(a[6].split(",") if a[6] else [])
    full = pii.find_pii(out.sparkSession.createDataFrame([(3, "IBAN DE89370400440532013000")], "doc_id int, text string")).first()
    assert full["n_added"] == 1 and full["found"][0]["score"] == 1.0 and full["spans"] == "iban:5:27"
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
