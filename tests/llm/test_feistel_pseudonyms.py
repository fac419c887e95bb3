import re
from datetime import date

from eddyline.llm import feistel_pseudonyms as f
from pyspark.sql import functions as F


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def cards(n):
    out = []
    for i in range(n):
        body = f"4{i * 7919:014d}"
        out.append(body + next(c for c in "0123456789" if luhn(body + c)))
    return out


def swapped(spark, values):
    df = spark.createDataFrame([(i, f"see {v} now") for i, v in enumerate(values)], "doc_id long, text string")
    out, name = f.pseudonymise(df)
    return {r["doc_id"]: (r["text"][4:-4], r[name]) for r in out.collect()}


def shape(value):
    return re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value)))


def test_formats_stay_valid_and_values_stay_apart(spark):
    values = {
        "card": cards(300),
        "phone": [f"+1 ({i:03d}) 555-{i * 3:04d}" for i in range(300)],
        "ip": [f"10.{i % 256}.{i * 7 % 256}.{i // 256}" for i in range(300)],
        "ssn": [f"{1 + i:03d}-{1 + i % 99:02d}-{1 + i * 13 % 9999:04d}" for i in range(300) if i != 665],
        "date": [date.fromordinal(date(1990, 1, 1).toordinal() + 17 * i).isoformat() for i in range(300)],
        "email": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}x.{i:03d}@mail.example.com" for i in range(300)],
    }
    for kind, originals in values.items():
        got = swapped(spark, originals)
        new = [got[i][0] for i in range(len(originals))]
        assert all(len(got[i][1]) == 1 and got[i][1][0]["kind"] == kind for i in got), kind
        assert len(set(new)) == len(set(originals)) and sum(a == b for a, b in zip(new, originals)) <= 2
        if kind != "ip":
            assert [shape(v) for v in new] == [shape(v) for v in originals]
        check = {"card": luhn, "ip": lambda v: all(0 <= int(o) <= 255 for o in v.split(".")), "date": date.fromisoformat}.get(kind)
        assert check is None or all(check(v) for v in new)


def test_adjacent_numbers_month_first_and_phones_abroad(spark):
    texts = {
        "4111 1111 1111 1111 12/27": [("card", "4111 1111 1111 1111")],
        "order 12 4111111111111111 ok": [("card", "4111111111111111")],
        "4111111111111111 152.143.123.131": [("card", "4111111111111111"), ("ip", "152.143.123.131")],
        "4111-1111-1111-1111 2020-01-02": [("card", "4111-1111-1111-1111"), ("date", "2020-01-02")],
        "3782 822463 10005 123-45-6789": [("card", "3782 822463 10005"), ("ssn", "123-45-6789")],
        "5500005555555559 4111111111111111": [("card", "5500005555555559"), ("card", "4111111111111111")],
        "4111 1111 1111 1112 12": [],
        "on 12/31/2020 and 31/12/2020": [("date", "12/31/2020"), ("date", "31/12/2020")],
        "call +44 20 7946 0958 or +49 30 123456, +33 1 42 68 53 00.": [("phone", "+44 20 7946 0958"), ("phone", "+49 30 123456"), ("phone", "+33 1 42 68 53 00")],
        "+44 20 7946 0958 4111111111111111": [("phone", "+44 20 7946 0958"), ("card", "4111111111111111")],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, name = f.pseudonymise(df)
    linked = set()
    for row, (text, want) in zip(out.orderBy("doc_id").collect(), texts.items()):
        assert [(v["kind"], v["value"]) for v in row[name]] == want, text
        for v in row[name]:
            assert shape(v["pseudonym"]) == shape(v["value"]) or v["kind"] == "ip"
            text = text.replace(v["value"], v["pseudonym"])
            linked |= {v["pseudonym"]} if v["value"] == "4111111111111111" else set()
        assert row["text"] == text
    assert len(linked) == 1 and luhn(linked.pop())


def test_small_domains_are_permuted(spark):
    df = spark.range(189 * 7).select(F.col("id"), f.feistel(F.array(F.floor(F.col("id") / 7), F.col("id") % 7), F.array(F.lit(189), F.lit(7)), "test", "k").alias("v"))
    assert df.select(F.col("v")[0] * 7 + F.col("v")[1]).distinct().count() == 189 * 7


def test_invalid_values_and_odd_rows(spark, frame, empty):
    text = "4111 1111 1111 1112 and 999.1.1.1 and 30.02.2001 and 666-12-1234 and 000-00-0000"
    df = frame("mail me at ann.lee@example.org or 4111-1111-1111-1111", text, "x" * 200_000 + " 4111111111111111")
    out, name = f.pseudonymise(df)
    assert out.columns == [*df.columns, name]
    rows = out.collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[1]["text"] == text and by_id[3]["text"] is None and by_id[4]["text"] == ""
    assert len({r["text"] for r in rows if r["text"] and r["text"].startswith("mail")}) == 1
    linked = [v["pseudonym"].replace("-", "") for r in (by_id[0], by_id[2]) for v in r[name] if v["kind"] == "card"]
    assert len(linked) == 2 and linked[0] == linked[1]
    assert f.pseudonymise(empty)[0].count() == 0


def test_the_key_matters_and_nothing_runs_in_python(spark, documents):
    a, b = (f.pseudonymise(documents.where("text LIKE '%@%'"), key=k)[0] for k in ("one", "two"))
    assert {r["text"] for r in a.collect()}.isdisjoint({r["text"] for r in b.collect()})
    assert not re.search("Python|Pandas|Arrow", a._jdf.queryExecution().executedPlan().toString())


def test_every_value_of_the_documents_is_replaced(spark):
    folder = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r["text"] for r in f.op3_feistel_pseudonyms(spark, folder).collect()}
    for doc_id, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        for value in re.findall(f.EMAIL, text) + [v for v in re.findall(f.CARD, text) if luhn(v)]:
            assert value not in out[doc_id]
