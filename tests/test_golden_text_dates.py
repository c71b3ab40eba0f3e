"""Golden tests for text keys and dates on dirty inline values."""

import datetime as dt

from pyspark.sql import functions as F

from clientele.functions import dates as D
from clientele.functions import text as X


def one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_name_keys(spark):
    assert one(spark, ["  Ann\t", None, "BOB"], X.name_key) == ["ann", "", "bob"]
    assert one(spark, ["  Ann\t", None], X.name_key_nan) == ["ann", "nan"]


def test_service_key(spark):
    vals = ["Package Laser RF Arm", "Facial & Peel: 5x", "Filler>Lips/3X", None, "add-on DJ rabu"]
    assert one(spark, vals, X.service_key) == ["rf arm", "facial peel", "filler lips", "", "on"]


def test_month_labels(spark):
    vals = ["jan24", " Okt 25", "may24", "agst24", "des25", "sept 24", "2024", "xyz", None]
    got = one(spark, vals, X.clean_month_label)
    assert got == ["january 24", "october 25", "may 24", "august 24", "desember 25",
                   "september 24", "20 24", "xyz", None]


def test_brackets(spark):
    name = "Ann Lee (VIP 2) (note a) (vip3)"
    assert one(spark, [name], X.vip_level) == ["2"]
    assert one(spark, [name], X.bracket_details) == ["note a"]
    assert one(spark, [name], X.strip_brackets) == ["Ann Lee"]
    assert one(spark, ["plain"], X.vip_level) == [""]


def test_title_case(spark):
    assert one(spark, ["red widget 5x", "O'NEIL-smith"], X.title_case) == ["Red Widget 5X", "O'Neil-Smith"]


def test_unknown_and_yes_no(spark):
    assert one(spark, [None, " nan ", "", "None", " x "], X.canonical_unknown) == \
        ["Unknown", "Unknown", "Unknown", "Unknown", "x"]
    assert one(spark, ["YES", " yes ", "no", None, "y"], X.canonical_yes_no) == ["Yes", "Yes", "No", "No", "No"]


def test_continuation_and_blank(spark):
    assert one(spark, [" *Address: Jl. A : 2", "*address", "other"], X.is_address_continuation) == [True, True, False]
    assert one(spark, [" *Address: Jl. A : 2", "*address"], X.continuation_text) == ["Jl. A : 2", ""]
    assert one(spark, ["  ", "", "a"], X.blank_to_null) == [None, None, "a"]


def test_normalize_dmy(spark):
    vals = ["9/5/1953", "29-01-70", "1-2-30", "1-2-31", "2024-01-05", "bad", None]
    assert one(spark, vals, D.normalize_dmy) == ["09-05-1953", "29-01-1970", "01-02-2030", "01-02-1931",
                                                 "2024-01-2005", "", ""]  # an ISO string is read as d-m-yy, as in the reference


def test_parse_birth_date(spark):
    vals = ["5-3-67", "5-3-29", "5-3-167", "5-3-140", "5-3-205", "5-3-1967", "31-2-1967", "5/3/1967", "n/a"]
    got = one(spark, vals, D.parse_birth_date)
    assert got == [dt.date(1967, 3, 5), dt.date(2029, 3, 5), dt.date(1967, 3, 5), dt.date(2030, 3, 5),
                   dt.date(2005, 3, 5), dt.date(1967, 3, 5), None, None, None]


def test_parse_any_date_steps(spark):
    vals = ["2024-01-05", "13/02/2024", "03/04/24", "2024-01-05 10:00:00", "n/a", "31/02/2024", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select(D.parse_date_steps("v").alias("p")).collect()
    got = [(r.p.date, r.p.step) for r in rows]
    assert got == [(dt.date(2024, 1, 5), "iso"), (dt.date(2024, 2, 13), "day_first"),
                   (dt.date(2024, 4, 3), "two_digit_year"), (dt.date(2024, 1, 5), "iso"),
                   (None, "failed"), (None, "failed"), (None, "failed")]


def test_age(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1),)], "b date")
    assert df.select(D.age_years(F.col("b"), "2026-01-01")).first()[0] == 26
