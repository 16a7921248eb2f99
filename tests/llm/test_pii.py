"""Personal data against plain Python, and against SQL on texts with weak forms and many matches."""

from __future__ import annotations

import random
import re
import time
from hashlib import sha256

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from classlens.llm.pii import find_personal_data, luhn, mod_97, op12_personal_data
from classlens.llm.pii_sql import personal_data

SCHEMA = "doc_id long, text string, spans int, kind string, `a.b` int"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def passes_luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base(text):
    t = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and passes_luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]


def with_check_digit(rnd, n):
    d = [rnd.randint(0, 9) for _ in range(n - 1)]
    return next("".join(map(str, [*d, x])) for x in range(10) if passes_luhn([*d, x]))


def texts():
    rnd = random.Random(12)
    alphabet = "0123456789" * 3 + "....----  ++@@()aZ%_é😀\n"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120))) for _ in range(500)]
    for _ in range(200):
        n = with_check_digit(rnd, rnd.randint(13, 20))
        grouped = rnd.choice([" ", "-", ""]).join(n[i : i + 4] for i in range(0, len(n), 4))
        word = rnd.choice(["card", "Credit", "order", "", "xcardx", "tel", "call", "SSN", "account"])
        other = rnd.choice(["a.b@c.de", "_@x.y.", "1.2.3.4", "001.255.0.300", "+1 (743) 555-3824", "(743) 555-3824", "123-45-6789",
                            "666-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 01",
                            "FR1420041010050500013M02606 NEXT", "ZZ1420041010050500013M02606"])
        out.append(f"é {word} {grouped}{rnd.choice([' ', 'x', ', '])}{word}: {other} {rnd.choice(['', 'invoice', 'phone'])}")
    out += [None, "", " \n", "a@b.c_d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+12345678+12345678", "1" * 16, "0" * 16]
    out += ["a@b.co 1.1.1.1 " * 700, "+49 30 1234567; " * 300, "9" * 40_000, "a" * 40_000 + "@b.c", "1." * 20_000, "1 " * 20_000]
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pii")
    table = pa.table({"doc_id": pa.array(range(len(texts()))), "text": pa.array(texts(), pa.string())})
    pq.write_table(table, path / "documents.parquet")
    return path


@pytest.fixture(scope="module")
def found(spark, folder):
    return {r.doc_id: r for r in op12_personal_data(spark, str(folder)).collect()}


def test_base_spans(found):
    assert len(found) == len(texts())
    for d, t in enumerate(texts()):
        want, r = base(t), found[d]
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == sha256(",".join(listed).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert set(listed) <= set(r.spans.split(","))


def test_equals_sql(found, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cursor = con.execute(personal_data())
    names = [x[0] for x in cursor.description]
    rows = cursor.fetchall()
    assert len(rows) == len(found)
    for row in rows:
        want = dict(zip(names, row))
        assert found[want["doc_id"]].asDict() == want, texts()[want["doc_id"]]


def spans(spark, text):
    r = find_personal_data(spark.createDataFrame([(1, text, 0, "", 0)], SCHEMA)).first()
    return [(s.kind, text[s.start : s.end], s.score, s.base) for s in r.spans]


def test_context_and_checksums_decide_weak_forms(spark):
    assert spans(spark, "Amex card 378282246310005.") == [("card", "378282246310005", 8, False)]
    assert spans(spark, "see 378282246310005.") == []
    assert spans(spark, "my card for order 378282246310005") == []
    assert spans(spark, "card 378282246310006") == []
    assert spans(spark, "order 4111-1111-1111-1111") == [("card", "4111-1111-1111-1111", 2, True)]
    assert spans(spark, "IBAN DE89 3704 0044 0532 0130 00 THANKS") == [("iban", "DE89 3704 0044 0532 0130 00", 10, False)]
    assert spans(spark, "GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432", 7, False)]
    assert spans(spark, "GB82WEST123456987654321") == [] and spans(spark, "GB83WEST12345698765432") == []
    assert spans(spark, "call (743) 555-3824") == [("phone", "(743) 555-3824", 7, False)]
    assert spans(spark, "call x(743) 555-3824") == [] and spans(spark, "take (743) 555-3824") == []
    assert spans(spark, "SSN: 123-45-6789 or 000-45-6789") == [("ssn", "123-45-6789", 7, False)]


def test_checksums(spark):
    rows = [("79927398713", True), ("79927398710", False), ("", False), ("4111 1111 1111 1111", True)]
    got = spark.createDataFrame(rows, "n string, want boolean").select(luhn(F.col("n")), "want").collect()
    assert all(a == b for a, b in got)
    rows = [("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 23", False), ("GB", False)]
    got = spark.createDataFrame(rows, "n string, want boolean").select(mod_97(F.col("n")), "want").collect()
    assert all(a == b for a, b in got)


def test_rows_and_keys(spark):
    df = spark.createDataFrame([(7, "a@b.cd", 1, "k", 2), (7, "a@b.cd", 1, "k", 2), (None, None, 1, "k", 2)], SCHEMA)
    assert sorted((r.doc_id or 0, len(r.spans)) for r in find_personal_data(df).collect()) == [(0, 0), (7, 1), (7, 1)]
    assert find_personal_data(df.limit(0)).collect() == []
    named = spark.createDataFrame([("k", "a@b.cd")], "`my.key` string, body string")
    assert find_personal_data(named, "my.key", "body").first()["my.key"] == "k"


def test_long_texts_stay_cheap(spark):
    hard = ["a" * 300_000, "a.b%" * 80_000 + "@", "1" * 300_000 + ".", "1-" * 150_000, "+" + "1 " * 150_000 + "x", "A" * 300_000, "x@y.z " * 20_000]
    df = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(hard)], SCHEMA)
    start = time.time()
    sizes = {r.doc_id: len(r.spans) for r in find_personal_data(df).collect()}
    assert sizes == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 20_000} and time.time() - start < 60


def test_no_python_workers(spark, folder):
    plan = op12_personal_data(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
