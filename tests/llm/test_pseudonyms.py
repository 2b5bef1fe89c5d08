import re
from datetime import date

import pytest
from corpus import documents

from fabtrail.llm import pseudonyms
from pyspark.sql import functions as F

KEY = "test key"


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if k % 2 == 0 else 2 * d - (9 if d > 4 else 0) for k, d in enumerate(digits)) % 10 == 0


def mod97(iban):
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


VALUES = {
    "card": ["4785380592391139", "4785 3805 9239 1139", "4337166598464399"],
    "phone": ["+1 (988) 555-2485", "+1 (456) 555-2186", "(988) 555-2485", "988-555-2485"],
    "ssn": ["123-45-6789"],
    "ip": ["152.143.123.131", "10.0.0.1"],
    "mail": ["bosbt.42@mail8.example.com", "a@b.de"],
    "date": ["2024-02-29", "29.02.2024", "02/29/2024", "1999-12-31"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
}


def test_values_keep_their_format_and_come_back(spark):
    every = [v for own in VALUES.values() for v in own]
    frame = spark.createDataFrame([(v,) for v in every], "v string")
    new = frame.withColumn("p", pseudonyms.pseudonym(F.col("v"), KEY))
    rows = new.withColumn("back", pseudonyms.pseudonym(F.col("p"), KEY, inverse=True)).collect()
    got = {r.v: r.p for r in rows}
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", t)))
    for r in rows:
        assert r.p != r.v and r.back == r.v
        if r.v not in VALUES["ip"]:
            assert shape(r.p) == shape(r.v)
    assert all(luhn(got[v]) for v in VALUES["card"])
    assert all(mod97(got[v]) == 1 and got[v][:2] == v[:2] for v in VALUES["iban"])
    assert all(0 <= int(o) <= 255 for v in VALUES["ip"] for o in got[v].split("."))
    # equal values in other punctuation stay linked
    assert got["4785 3805 9239 1139"].replace(" ", "") == got["4785380592391139"]
    iso, dotted, slashed = (got[v] for v in VALUES["date"][:3])
    y, m, d = iso.split("-")
    assert date.fromisoformat(iso) and dotted == f"{d}.{m}.{y}" and slashed == f"{m}/{d}/{y}"


def test_values_before_other_groups(spark):
    """A BIC, a year, an expiry date or a code behind a value that the pattern takes with it."""
    iban, long_iban, card = "BE68 5390 0754 7034", "ES9121000418450200051332", "4111 1111 1111 1111"
    texts = [
        f"{iban} BIC KREDBEBB", f"{long_iban} 2024", f"{card} 12/27", f"{card.replace(' ', '')} 123", f"{iban} {card}",
        f"AB12 {card}", iban, long_iban, card, "4111 1111 1111 1112 12",
    ]
    rows = [(k, t, "a") for k, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymised(documents(spark, rows), KEY).collect()}
    assert got[6] != iban and got[7] != long_iban and got[8] != card
    assert [got[k] for k in range(6)] == [
        f"{got[6]} BIC KREDBEBB", f"{got[7]} 2024", f"{got[8]} 12/27", f"{got[8].replace(' ', '')} 123", f"{got[6]} {got[8]}",
        f"AB12 {got[8]}",
    ]
    assert got[9] == texts[9]


def test_small_domain_is_permuted(spark):
    frame = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("v"))
    got = [r[0] for r in frame.select(pseudonyms.permute_characters(F.col("v"), KEY)).collect()]
    assert len(set(got)) == 100 and all(re.fullmatch("[0-9]{2}", g) for g in got)
    days = spark.range(500).select(F.expr("date_add(date'1799-06-01', cast(id as int))").alias("d"))
    moved = days.select(pseudonyms.permute_date(F.col("d"), KEY).alias("m"))
    assert moved.distinct().count() == 500


@pytest.mark.parametrize("clashing", [False, True])
def test_texts(spark, clashing):
    rows = [
        (1, "Call +1 (988) 555-2485, or write to bosbt.42@mail8.example.com.", "a"),
        (2, "+1 (988) 555-2485", "a"),
        (3, None, "a"),
        (4, "", "a"),
        (5, "Numbers 4785380592391138 and 999.1.1.1 and 2024-02-30 and version 2.0. stay, 12 too", "a"),
        (6, "no digits", "a"),
        (7, "x 152.143.123.131### 4785380592391139$$$", "a"),
        (None, "10.0.0.1", None),
        (8, "w " * 30000 + "10.0.0.1 10.0.0.1", "a"),
    ]
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(documents(spark, rows, clashing), KEY).collect()}
    assert got[1].n_values == 2 and got[1].n_changed == 2
    phone = got[2].text
    assert phone != rows[1][1] and got[1].text.startswith(f"Call {phone}, or write to ")
    assert (got[3].text, got[3].n_values) == (None, 0) and got[4].text == ""
    assert got[5].text == rows[4][1] and got[5].n_changed == 0
    assert got[6].text == "no digits"
    assert "152.143" not in got[7].text and "4785380592391139" not in got[7].text and got[7].text.endswith("$$$")
    a, b = got[8].text.split()[-2:]
    assert a == b == got[None].text
    assert pseudonyms.pseudonymised(documents(spark, []), KEY).collect() == []


def test_slashed_dates_stay_apart(spark):
    """All days of three years, month first and day first."""
    days = spark.range(1096).select(F.expr("date_add(date'2009-01-01', cast(id as int))").alias("d"))
    written = days.select(F.explode(F.array(F.date_format("d", "MM/dd/yyyy"), F.date_format("d", "dd/MM/yyyy"))).alias("v")).distinct()
    got = written.withColumn("p", pseudonyms.pseudonym(F.col("v"), KEY)).repartition(8)
    rows = got.withColumn("back", pseudonyms.pseudonym(F.col("p"), KEY, inverse=True)).collect()
    assert len(rows) > 1700 and len({r.p for r in rows}) == len(rows)
    for r in rows:
        assert r.back == r.v and re.fullmatch("[0-9]{2}/[0-9]{2}/[0-9]{4}", r.p)
        assert (int(r.v[:2]) > 12) == (int(r.p[:2]) > 12)
