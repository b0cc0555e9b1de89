"""Amounts, dates and text fields against tables of examples."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.functions import results as R
from tallyloom.functions import scalar as S
from tallyloom.functions.amounts import read_amount
from tallyloom.functions.instants import read_instant, written
from tallyloom.options import ReconOptions, ToleranceRule


def applied(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_references(spark):
    cases = {"REF-12345-ABC": "REF12345ABC", "ref 12345 abc": "REF12345ABC", "REF/12345/ABC": "REF12345ABC", "ALREADY": "ALREADY", "": "", "   ": "", " - ": "", "///": "", "\tref ": "REF", None: None}
    assert applied(spark, cases, S.normalize_reference) == list(cases.values())


def test_lenient_amounts(spark):
    cases = {
        "100.005": "100.01", "100.004": "100.00", "-250.505": "-250.51", "1,234.56": "1234.56", "100,50": "100.50", "0": "0.00", "not-a-number": None, "abc": None, "": None, "1,234": "1.23",
        "1,234,567": None, "1.234,56": "1234.56", "(100)": "-100.00", "100-": "-100.00", "+5": "5.00", "1e3": "1000.00", "¤ 5": "5.00", "--5": None, "(5": None, None: None, "9" * 40: None,
    }
    assert applied(spark, cases, S.normalize_amount) == [v and D(v) for v in cases.values()]


def test_strict_amounts(spark):
    cases = {
        "1,234.56": "1234.56", "1.234,56": "1234.56", "100,50": "100.50", " 5.00 ": "5.00", "(446.97)": "-446.97", "319.87-": "-319.87", "-3,286.42": "-3286.42", "1.2.3,4,5": None, "12.3.4": None, "4..5": None, "--5.00": None,
        "1O0.00": None, "NaN": None, "EUR": None, "": None, "7": "7.00", "1,23.45": None, "1 2 x": None, None: None, " 5.00": "5.00",
    }
    assert applied(spark, cases, read_amount) == [v and D(v) for v in cases.values()]


def test_lenient_dates(spark):
    cases = {"2024-01-15": "2024-01-15 00:00:00", "15/01/2024": "2024-01-15 00:00:00", "05/06/2024": "2024-05-06 00:00:00", "20240115": "2024-01-15 00:00:00", "2024-01-15T14:00:00+02:00": "2024-01-15 12:00:00", "not-a-date": None, "99/99/9999": None, "2024": None, "15.01.2024": "2024-01-15 00:00:00", "": None, None: None, "3 Jan 2024": "2024-01-03 00:00:00", "2024-02-30": None}
    assert applied(spark, cases, lambda c: F.date_format(S.parse_date(c), "yyyy-MM-dd HH:mm:ss")) == list(cases.values())


def test_text_fields(spark):
    assert applied(spark, ["  payment for invoice  ", "mixed CASE", " ", None], S.normalize_description) == ["PAYMENT FOR INVOICE", "MIXED CASE", "", ""]
    assert applied(spark, ["GB29 NWBK 6016 1331 9268 19", "gb29nwbk", "gb29 nwbk", "", None], S.normalize_iban) == ["GB29NWBK60161331926819", "gb29nwbk", "GB29NWBK", "", None]
    assert applied(spark, ["eur", "  gbp  ", "", "US", "EURO", "123", None], S.currency_code) == ["EUR", "GBP", None, None, None, "123", None]
    assert applied(spark, ["3f2504e0-4f89-11d3-9a0c-0305e82c3301", "00000000-0000-0000-0000-000000000000", "x", None], S.valid_transaction_id) == [True, False, False, False]


def test_money_and_confidence(spark):
    assert applied(spark, [D("100.005"), D("-100.005"), None], S.round_money, "decimal(20,4)") == [D("100.01"), D("-100.01"), None]
    assert applied(spark, [D("1.2345"), D("-0.5")], S.minor_units, "decimal(20,4)") == [12345, -5000]
    assert applied(spark, [12345], S.from_minor_units, "bigint") == [D("1.2345")]
    with pytest.raises(Exception, match="four decimals"):
        applied(spark, [D("1.23456")], S.minor_units, "decimal(20,5)")
    assert applied(spark, [D("0.77777"), D(0), D(1)], S.confidence, "decimal(10,5)") == [D("0.7778"), D(0), D(1)]
    with pytest.raises(Exception, match="confidence"):
        applied(spark, [D("1.001")], S.confidence, "decimal(10,5)")
    assert applied(spark, [D(".95"), D(".89"), D(".60"), None], S.confidence_band, "decimal(5,4)") == ["High", "Medium", "Low", None]
    with pytest.raises(Exception, match="different currencies"):
        applied(spark, [D(1)], lambda c: S.add_money(c, F.lit("EUR"), c, F.lit("USD")), "decimal(18,2)")


def test_tolerances(spark):
    cases = [("100", "100.009", "0.01", "0", True), ("100", "100.02", "0.01", "0", False), ("1000", "1004.9", "0", "0.5", True), ("1000", "1005.1", "0", "0.5", False), ("0", "0.01", "0", "100", False)]
    for s, t, a, p, want in cases:
        got = spark.range(1).select(P.amount_within(F.lit(s).cast("decimal(18,4)"), F.lit(t).cast("decimal(18,4)"), ToleranceRule(a, p, 0))).first()[0]
        assert got is want, (s, t)
    days = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, d)) for d in (1, 3, 4)], "a date, b date")
    assert [r[0] for r in days.select(P.date_within(F.col("a"), F.col("b"), ToleranceRule(0, 0, 2))).collect()] == [True, True, False]
    for s, t, want in [("1000", "500", True), ("1000", "300", False), ("600", "100", True), ("7", "3", False), ("0.10", "0.05", True), ("900", "900", False), ("900", "0", False), ("-900", "-300", True)]:
        for divides in P.DIVISIBILITY.values():
            assert spark.range(1).select(P.partial_split(F.lit(s).cast("decimal(18,2)"), F.lit(t).cast("decimal(18,2)"), divides)).first()[0] is want, (s, t)


def test_options():
    assert ReconOptions().tolerance == ToleranceRule(5, D("0.50"), 3)
    assert ReconOptions.from_dict({"FuzzyMatchMinConfidence": 0.5, "Tolerance": {"DateWindowDays": 7}}).tolerance.date_window_days == 7
    assert ReconOptions(tolerance=ToleranceRule.lenient()).with_tolerance(date_window_days=7).tolerance == ToleranceRule(5, D("0.50"), 7)
    for bad in ({"fuzzy_min": "0.95"}, {"exact_confidence": 2}, {"partial_min": -1}, {"fuzzy_max": "1.1"}):
        with pytest.raises(ValueError):
            ReconOptions(**bad)
    for bad in ((-1, 0, 0), (0, 101, 0), (0, 0, -1)):
        with pytest.raises(ValueError):
            ToleranceRule(*bad)


LABELS = {"CET": 60, "EST": -300}


@pytest.mark.parametrize(
    ("text", "order", "zone", "want"),
    [
        ("2024-01-15", "DMY", "UTC", "2024-01-15"),
        (" 2024-01-15 ", "DMY", "UTC", "2024-01-15"),
        ("05/06/2024", "DMY", "UTC", "2024-06-05"),
        ("05/06/2024", "MDY", "UTC", "2024-05-06"),
        ("25/12/2024", "MDY", "UTC", None),
        ("05-06-24", "DMY", None, "2024-06-05"),
        ("05/06-2024", "DMY", None, None),
        ("05/06/2024", None, None, None),
        ("20240115", None, None, "2024-01-15"),
        ("20240230", None, None, None),
        ("0000-00-00", None, None, None),
        ("20230103T131351Z", None, None, "2023-01-03T13:13:51.000000Z"),
        ("20230110041408", None, "Europe/Berlin", "2023-01-10T03:14:08.000000Z"),
        ("1672694925", None, None, "2023-01-02T21:28:45.000000Z"),
        ("1672754258123", None, None, "2023-01-03T13:57:38.123000Z"),
        ("2023-06-03 22:26:45 CET", None, None, "2023-06-03T21:26:45.000000Z"),
        ("2023-06-03 22:26:45 XYZ", None, "UTC", None),
        ("2023-01-01T01:30:03+01:00[Europe/Berlin]", None, None, "2023-01-01T00:30:03.000000Z"),
        ("2023-01-01T01:30:03+05:00[Europe/Berlin]", None, None, None),
        ("2023-01-01T01:30:03+01:00[Nowhere/None]", None, None, None),
        ("2023-03-26 02:30:00", None, "Europe/Berlin", None),
        ("2023-10-29 02:30:00", None, "Europe/Berlin", None),
        ("2023-10-29 02:30:00", None, "UTC", "2023-10-29T02:30:00.000000Z"),
        ("2023-10-29T02:30:00+0200", None, None, "2023-10-29T00:30:00.000000Z"),
        ("01/08/2023 08:54:30 PM", "MDY", "America/Chicago", "2023-01-09T02:54:30.000000Z"),
        ("01/08/2023 13:54:30 PM", "MDY", "UTC", None),
        ("Tue, 03 Jan 2023 10:32:10 +0100", None, None, "2023-01-03T09:32:10.000000Z"),
        ("Mon, 03 Jan 2023 10:32:10 +0100", None, None, None),
        ("11 Jan 2023", None, None, "2023-01-11"),
        ("Jan 4, 2023", None, None, "2023-01-04"),
        ("2023-06-15T25:61:00", None, "UTC", None),
        ("2023-06-15T23:59:60", None, "UTC", None),
        ("2024-01-30T14:50:58.2+05:45", None, None, "2024-01-30T09:05:58.200000Z"),
        ("2024-01-30T14:50:58+15:00", None, None, None),
        ("2024-01-30 14:50", None, None, None),
        ("soon", "DMY", "UTC", None),
        ("", "DMY", "UTC", None),
        ("9" * 1000, "DMY", "UTC", None),
        (None, "DMY", "UTC", None),
    ],
)
def test_instants(text, order, zone, want):
    assert written(read_instant(text, order, zone, LABELS)) == want


def test_drafts():
    draft = ReconOptions.draft().exact("0.9").fuzzy("0.5", "0.8").partial("0.4").tolerance(date_window_days=7)
    made = draft.build()
    assert (made.exact_confidence, made.fuzzy_min, made.partial_min, made.tolerance.date_window_days, made.tolerance.absolute) == (D("0.9"), D("0.5"), D("0.4"), 7, D("5.00"))
    assert ReconOptions.draft(made).build() == made and draft.exact(1).build().exact_confidence == 1
    with pytest.raises(ValueError):
        draft.fuzzy("0.8", "0.8").build()


def test_results_pass_errors_on(spark):
    rows = spark.createDataFrame([(4,), (None,), (-3,)], "v int")
    first = R.checked(F.col("v"), "int", "missing")
    second = R.then(first, lambda v: F.when(v > 0, R.success(v)).otherwise(R.failure("negative", "int")), "int")
    got = rows.select(R.mapped(second, lambda v: v * 2, "int").alias("r")).select("r.value", "r.error.message").collect()
    assert [tuple(r) for r in got] == [(8, None), (None, "missing"), (None, "negative")]
    assert rows.where("v = 4").select(R.value_or_raise(second, "int")).first()[0] == 4
    with pytest.raises(Exception, match="negative"):
        rows.where("v = -3").select(R.value_or_raise(second, "int")).collect()
    with pytest.raises(Exception, match="three characters"):
        rows.select(S.money(F.lit(1).cast("decimal(18,2)"), F.lit("EURO"))).collect()
