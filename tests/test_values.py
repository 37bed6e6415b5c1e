import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.functions import values

PRICES = [
    ("£51.77", 51.77), ("$1,234.56", 1234.56), ("1.234,56 €", 1234.56), ("39,000원", 39000.0), ("₩1,500,000", 1500000.0), ("3억 5,000만원", 350000000.0), ("12만원", 120000.0), ("1 234,50 €", 1234.5),
    ("5,5", 5.5), ("무료", 0.0), ("Free", 0.0), ("-$5.00", -5.0), ("가격 문의", None), ("12", 12.0), ("£-5", 5.0), ("(3)", -3.0), ("", None), (None, None),
]
CURRENCIES = [
    ("£51.77", "GBP"), ("$1", "USD"), ("US$ 3", "USD"), ("HK$12", "HKD"), ("C$4", "CAD"), ("39,000원", "KRW"), ("₩10", "KRW"), ("€3", "EUR"), ("1200円", "JPY"), ("¥1200", "JPY"), ("30元", "CNY"),
    ("USD 12", "USD"), ("eur 5", "EUR"), ("R$ 10", "BRL"), ("12", None), ("USD원", "USD"),
]
LINKS = [
    ("https://a.com/x?id=1&utm_source=chatgpt.com", "https://a.com/x?id=1"), ("https://a.com/x?utm_source=a&utm_medium=b", "https://a.com/x"), ("/p?fbclid=1&q=2#c", "/p?q=2#c"),
    ("https://a.com/x?id=1", "https://a.com/x?id=1"), ("https://n.com/a?gclid=z", "https://n.com/a"), ("", None),
]
DATES = [
    ("5시간 전", "2026-10-23 07:00:00"), ("3 hours ago", "2026-10-23 09:00:00"), ("5h", "2026-10-23 07:00:00"), ("30분 전", "2026-10-23 11:30:00"), ("an hour ago", "2026-10-23 11:00:00"), ("2일 전", "2026-10-21 12:00:00"),
    ("방금", "2026-10-23 12:00:00"), ("3時間前", "2026-10-23 09:00:00"), ("2天前", "2026-10-21 12:00:00"), ("Fri Oct 23 04:54:24 +0000 2026", "2026-10-23 13:54:24"), ("어제", "2026-10-22"), ("yesterday", "2026-10-22"),
    ("5 minutes", "5 minutes"), ("오늘 저녁", "오늘 저녁"), ("1792568031775", "2026-10-21 16:33:51"), ("1792547248", "2026-10-21 10:47:28"), ("1792568031775000", "2026-10-21 16:33:51"),
    ("2026-10-22T01:00:00.000Z", "2026-10-22 10:00:00"), ("2026-10-21T10:00:00-04:00", "2026-10-21 23:00:00"), ("Wed, 21 Oct 2026 06:00:00 GMT", "2026-10-21 15:00:00"), ("2026-10-21 13:52:42", "2026-10-21 13:52:42"),
    ("2026-10-21T09:05", "2026-10-21 09:05:00"), ("2026-10-21", "2026-10-21"), ("미정", "미정"), ("2026. 10. 21. 15:10", "2026-10-21 15:10:00"), (None, None),
]


def results(spark, build, cases):
    frame = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, v string")
    return [r.g for r in frame.select("k", build(F.col("v")).alias("g")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("build", "cases"),
    [
        (values.price, PRICES), (values.currency, CURRENCIES), (values.clean_url, LINKS), (lambda c: values.date(c, "Asia/Seoul", F.timestamp_seconds(F.lit(1_792_724_400))), DATES),
        (values.number, [("1.234,56 €", 1.23456), ("-", None), ("a", None), ("12", 12.0)]), (values.squeeze, [("  a \n b ", "a b"), ("", "")]),
        (values.kind_of, [("£10.00", "price"), ("Book number 1", "text"), ("/b/1", "url"), ("https://a.test/x", "url"), ("2026-10-23 10:00", "date"), ("3 hours ago", "date"), ("1,234", "number"), ("", "empty"), ("x" * 81, "longtext")]),
        (lambda c: values.first_match(c, "a(b)?c"), [("ac", "ac"), ("abc", "b"), ("x", None)]), (lambda c: values.first_match(c, "A(.)", "i"), [("xay", "y")]),
        (lambda c: values.mapped(c, {"One": 1}), [("One", "1"), ("Two", "Two"), (None, None)]), (lambda c: values.shorten(c, 4), [("abcde", "abc…"), ("abcd", "abcd")]),
    ],
)
def test_cells(spark, build, cases):
    assert results(spark, build, cases) == [w for _, w in cases]


def test_utc_zone_and_month_overflow(spark):
    assert results(spark, lambda c: values.date(c, "UTC"), [("1792568031775", "")]) == ["2026-10-21 07:33:51"]
    now = F.to_timestamp(F.lit("2024-03-31 00:00:00"))
    assert results(spark, lambda c: values.date(c, "UTC", now), [("1 month ago", ""), ("1 year ago", "")]) == ["2024-03-02 00:00:00", "2023-03-31 00:00:00"]


def test_empty_cells(spark):
    frame = spark.createDataFrame([("", [], 0.0, False), (None, None, None, None)], "s string, a array<string>, n double, b boolean")
    got = frame.select(*[values.non_empty(F.col(c), frame.schema[c].dataType).alias(c) for c in frame.columns]).collect()
    assert [tuple(r) for r in got] == [(False, False, True, True), (False, False, False, False)]


def test_template(spark):
    frame = spark.createDataFrame([(1.0, "x"), (2.5, "")], "n double, s string")
    cells = {"n": (F.col("n"), T.DoubleType()), "s": (F.col("s"), T.StringType())}
    assert [r[0] for r in frame.select(values.template("u/{n}/{s}", cells)).collect()] == ["u/1/x", None]
