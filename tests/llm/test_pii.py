import datetime
import re

from pyspark.sql import functions as F

from lexitilt.llm import pii

SCHEMA = "doc_id long, text string"
KEY = "k"


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def with_check(body):
    return next(f"{body}{c}" for c in range(10) if luhn(f"{body}{c}"))


def run(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r.text for r in pii.mask(df, key).orderBy("doc_id").collect()]


ODD = [None, "", "no values 2.0. 3.", "999.1.1.1 2023-02-30 666-11-1111 4715744394561981",
       "a@b.co " * 50, "9" * 5000, "x" * 70 + "@long.example.com", "\n.@. +1 ()"]


def test_round_trip_gives_the_texts_back(spark):
    texts = ODD + [
        "Mail ssm.19@mail7.example.com, A@b.co or +1 (408) 555-7800, 408-555-7800. Card "
        "4715744394561980 and 4715-7443-9456-1980; ip 41.225.16.185, born 1984-02-29 29.02.1984 "
        "02/29/1984 1984/02/29; id 123-45-6789."] * 2
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("pii_kind", F.lit(1))
    made = pii.pseudonymised(df, KEY)
    back = pii.pseudonymised(made.select("doc_id", "text"), KEY, undo=True)
    assert [r.text for r in back.orderBy("doc_id").collect()] == texts
    first = made.orderBy("doc_id").collect()
    assert [r.text for r in first[:4]] == ODD[:4] and first[5].text == ODD[5]
    assert first[-1].text == first[-2].text != texts[-1]
    assert len(first[-1].pii_kinds) == 12 and first[-1].pii_kind == 1


def test_formats_hold_and_no_two_values_meet(spark):
    cards = [with_check(f"4{k:014d}") for k in range(300)]
    dates = [(datetime.date(1950, 1, 1) + datetime.timedelta(97 * k)).isoformat() for k in range(300)]
    phones = [f"+1 ({200 + k}) 555-{k:04d}" for k in range(300)]
    ips = [f"10.{k % 7}.{k}.1" if k < 256 else f"11.1.{k - 256}.1" for k in range(300)]
    ids = [f"{k + 1 + (k >= 665):03d}-{k % 99 + 1:02d}-{k + 1:04d}" for k in range(300)]
    names = [f"ab{k:03d}.c@example.org" for k in range(300)]
    out = run(spark, [f"{a} | {b} | {c} | {d} | {e} | {f}" for a, b, c, d, e, f in
                      zip(cards, dates, phones, ips, ids, names)])
    columns = list(zip(*[t.split(" | ") for t in out]))
    for made, was in zip(columns, (cards, dates, phones, ips, ids, names)):
        assert len(set(made)) == 300 and sum(x == y for x, y in zip(made, was)) < 5
    assert all(luhn(c) and re.fullmatch(r"4\d{15}", c) for c in columns[0])
    assert all(1800 <= datetime.date.fromisoformat(d).year < 2200 for d in columns[1])
    assert all(re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", p) for p in columns[2])
    assert all(max(int(x) for x in p.split(".")) < 256 for p in columns[3])
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", p) for p in columns[4])
    assert all(re.fullmatch(r"[a-z]{2}\d{3}\.[a-z]@example\.org", p) for p in columns[5])


def test_equal_values_stay_linked_and_keys_differ(spark):
    texts = ["call +1 (408) 555-7800", "or 408-555-7800", "on 1984-03-02", "02.03.1984 03/02/1984"]
    a, b = run(spark, texts), run(spark, texts, "other")
    digits = [re.sub(r"\D", "", t) for t in a]
    assert digits[0] == "1" + digits[1]
    y, m, d = digits[2][:4], digits[2][4:6], digits[2][6:]
    assert digits[3] == d + m + y + m + d + y
    assert all(x != y for x, y in zip(a, b))


def test_counts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "1.2.3.4 and 1.2.3.4, a.b@c.de"), (1, None)], SCHEMA)
    got = {(r.n_values, r.n_ip, r.n_email, r.n_card) for r in pii.mask(df, KEY).collect()}
    assert got == {(3, 2, 1, 0), (0, 0, 0, 0)}
    assert pii.mask(spark.createDataFrame([], SCHEMA), KEY).collect() == []


def test_phone_numbers_outside_the_plan_are_replaced(spark):
    phones = [f"+1 ({k:03d}) {e}55-77{k % 100:02d}" for k in range(200) for e in (0, 5)] \
        + [f"{k}08-{e}55-7800" for k in range(2, 10) for e in (0, 1)]
    df = spark.createDataFrame(list(enumerate(phones)), SCHEMA)
    made = pii.pseudonymised(df, KEY)
    out = [r.text for r in made.orderBy("doc_id").collect()]
    assert len(set(out)) == len(phones) and sum(x == y for x, y in zip(out, phones)) < 5
    assert all(re.sub(r"\d", "0", x).replace("+0", "+1") == re.sub(r"\d", "0", y).replace("+0", "+1")
               for x, y in zip(out, phones))
    first = [re.sub(r"\D", "", x)[-10:] for x in out]
    assert all(x[0] < "2" or x[3] < "2" for x in first)
    back = pii.pseudonymised(made.select("doc_id", "text"), KEY, undo=True)
    assert [r.text for r in back.orderBy("doc_id").collect()] == phones


def test_columns_of_any_name_are_kept(spark):
    text = "Mail ann.lee@example.org on 2024-03-05."
    df = spark.createDataFrame([(1, text), (2, None), (2, "x " * 60_000 + text)], SCHEMA).withColumns(
        {c: F.lit(c) for c in ("_made", "made", "row", "pii_kinds", "new", "was", "a.b")})
    out = pii.pseudonymised(df, "k", kinds_as=None)
    assert sorted(out.columns) == sorted(df.columns)
    rows = out.collect()
    assert all(r["pii_kinds"] == "pii_kinds" and r["made"] == "made" and r["a.b"] == "a.b" for r in rows)
    assert all((r.text is None) == (k is None) for r, k in zip(rows, (text, None, text)))
    assert "ann.lee" not in rows[0].text and "ann.lee" not in rows[2].text
    shown = pii.pseudonymised(df, "k").first()
    assert sorted(shown["pii_kinds"]) == ["date", "email"] and shown["_made"] == "_made"
