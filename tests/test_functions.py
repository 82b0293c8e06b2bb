from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boxoffice.functions import columns as c
from tests.conftest import rows


@pytest.mark.parametrize(
    ("email", "valid"),
    [
        ("a..b@x.com", True),
        ("a[b]@x.com", True),
        ("a.@x.com", True),
        ("arthur.morgan@test.com", True),
        ("a@x-y.co.uk", True),
        ("a+b@x.com", False),
        ("invalid@testcom", False),
        (".a@x.com", False),
        ("a@x.com\n", False),
        ("a@x.c", False),
        ("a@-x.com", False),
        ("", False),
        (None, False),
    ],
)
def test_email(spark, email, valid):
    df = spark.createDataFrame([(email,)], "e STRING")
    assert df.select(c.is_email_valid("e")).first()[0] is valid


@pytest.mark.parametrize(
    ("password", "valid"),
    [
        ("GoodManArthur36!", True),
        ("Password12345!", True),
        ("weak", False),
        ("nouppercase123", False),
        ("NOLOWERCASE123", False),
        ("NoDigitsAtAll!!", False),
        ("Has Space 12345", False),
        ("Has Space12345", False),
        ("Aa1aaaaaaaa", False),
        ("Aa1aaaaaaaaa", True),
        ("Aa1" + "a" * 17, True),
        ("Aa1" + "a" * 18, False),
        ("Éé1aaaaaaa", True),  # 10 characters, 12 bytes
        (None, False),
    ],
)
def test_password(spark, password, valid):
    df = spark.createDataFrame([(password,)], "p STRING")
    assert df.select(c.is_password_valid("p")).first()[0] is valid


@pytest.mark.parametrize(
    ("text", "moment"),
    [
        ("1999-02-28 19:30", datetime(1999, 2, 28, 19, 30)),
        ("1999-02-28 9:30", datetime(1999, 2, 28, 9, 30)),
        ("1999-02-30 19:30", None),
        ("1999-02-28", None),
        ("1999-02-28 19:30:00", None),
        ("1999-02-28 24:30", None),
        ("1999-2-28 19:30", None),
        ("", None),
        (None, None),
    ],
)
def test_show_date(spark, text, moment):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(c.parse_show_date("t")).first()[0] == moment


def test_ids(spark):
    plain = "0f8fad5b-d9cb-469f-a165-70867728950e"
    texts = [plain, plain.upper(), "{" + plain + "}", "urn:uuid:" + plain, plain.replace("-", "")]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert rows(df.select(c.parse_id(F.col("t"), "string"))) == {(plain,)}
    bad = spark.createDataFrame([("nope",), (plain[:-1],), ("",), (None,)], "t STRING")
    assert rows(bad.select(c.parse_id(F.col("t"), "string"))) == {(None,)}
    numbers = spark.createDataFrame([("12",), ("x",)], "t STRING")
    assert rows(numbers.select(c.parse_id(F.col("t"), "bigint"))) == {(12,), (None,)}


def test_money(spark):
    df = spark.sql("select cast('10.05' as decimal(10,2)) m, 1005L n")
    assert df.select(c.from_cents(F.lit(10**12))).first()[0] is None
    assert df.select(c.money(F.lit(123456789))).first()[0] is None
    assert str(df.select(c.from_cents("n")).first()[0]) == "10.05"


def test_texts(spark):
    df = spark.createDataFrame([("Ann", None, " ", "")], "a STRING, b STRING, s STRING, e STRING")
    got = df.select(
        c.full_name("a", "b"),
        c.fill("Hi {x}, {y}!", x=F.col("a"), y=F.col("b")),
        c.text("%s and %s", F.col("a"), F.lit(3)),
        c.first_not_blank("s", "a"),
        c.first_not_blank("e", "s"),
        c.null_if_blank_text("e"),
        c.null_if_blank_text("s"),
    ).first()
    assert tuple(got) == ("Ann ", "Hi Ann, !", "Ann and 3", "Ann", " ", None, " ")
