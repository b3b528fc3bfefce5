"""Readings of numbers and dates, checksums, serial numbers."""

import pytest
from pyspark.sql import functions as F

from tabsieve.functions import readings as R
from tabsieve.functions.cultures import CULTURES, culture


def read(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", make(F.col("t")).cast("string").alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_integers_need_whole_groups(spark):
    de = culture("de-DE")
    assert read(spark, ["1.5", "1.500", "12.345.678", "1234.567", "12.34", "-7", "+7", " 8 ", "9223372036854775808", ""], lambda t: R.integer(t, de)) == [None, "1500", "12345678", "1234567", None, "-7", "7", "8", None, None]


def test_decimals(spark):
    got = read(spark, ["19.99", "1.234,50", "7,5", "5-", "1e3", ",5", "1,", "x", "1.2,3.4"], lambda t: R.canonical_number(R.decimal(t, culture("de-DE"))))
    assert got == [None, "1234.5", "7.5", "-5", "1000", "0.5", "1", None, None]
    assert read(spark, ["1,5", "1,500.25"], lambda t: R.canonical_number(R.decimal(t, culture("")))) == [None, "1500.25"]


def test_other_separator(spark):
    got = read(spark, ["48.183604", "34,02", "1.234", "5.", "1.2.3"], lambda t: R.other_separator(t, culture("de-DE")).isNotNull())
    assert got == ["true", "false", "false", "false", "false"]


def test_partial_dates_are_no_dates(spark):
    texts = ["Jan 5", "3/15", "January 2023", "1.5", "08:30", "Mon 17 Sep", "15.01", "2024-13-01", "30/02/2024"]
    for name in ("", "de-DE", "en-US"):
        assert read(spark, texts, lambda t, name=name: R.date(t, culture(name))) == [None] * len(texts)


def test_dates(spark):
    assert set(read(spark, ["17 SEP 1992", "17 September 1992", "September 17, 1992", "1992-09-17", "9/17/1992"], lambda t: R.date(t, culture("en-US")))) == {"1992-09-17 00:00:00"}
    assert read(spark, ["17. September 1992", "17.09.1992", "03.04.2024 10:20", "2024-01-02T10:20:30.5Z"], lambda t: R.date(t, culture("de-DE"))) == ["1992-09-17 00:00:00", "1992-09-17 00:00:00", "2024-04-03 10:20:00", "2024-01-02 10:20:30.5"]


def test_checksums(spark):
    luhn = ["US0378331005", "DE0007164600", "4539578763621486", "US0378331006", "", "US03783310-5", None]
    assert read(spark, luhn, R.luhn) == ["true", "true", "true", "false", "false", "false", "false"]
    mod = ["529900T8BM49AURSDO55", "5493001KJTIIGC8Y1R12", "529900T8BM49AURSDO56", "529900t8bm49aursdo55", ""]
    assert read(spark, mod, R.mod97) == ["true", "true", "false", "false", "false"]


def test_serials(spark):
    df = spark.createDataFrame([(1.0,), (59.0,), (60.5,), (61.0,), (44927.0,), (-1.0,)], "n double")
    assert [str(r[0]) if r[0] else None for r in df.select(R.from_serial(F.col("n"))).collect()] == ["1900-01-01 00:00:00", "1900-02-28 00:00:00", None, "1900-03-01 00:00:00", "2023-01-01 00:00:00", None]
    assert str(spark.range(1).select(R.from_serial(F.lit(43465.0), True)).first()[0]) == "2023-01-01 00:00:00"


def test_lengths_and_trim(spark):
    assert read(spark, ["a😀", " x\t"], R.length16) == ["3", "3"]
    assert read(spark, [" x\t", "  "], R.trimmed) == ["x", None]


def test_unknown_culture():
    with pytest.raises(ValueError):
        culture("xx-XX")
    assert len(CULTURES) == 12
