"""Copies, timestamps and rejected lines, on small tables with every awkward value."""

import csv
import io
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.copies import by_column, case_rows, diff_copies, ledger_differences, reason_form
from tallyloom.operators.rejects import load_lines, loaded_rows, row_errors, split_line
from tallyloom.operators.timestamps import InstantDictionary, changed_timestamps, normalise_timestamps
from tallyloom.plans.shared import hot_keys, lookup, write_table

KEYS = "source_file string, row_number int"
RAW_COPY = f"{KEYS}, reference string, amount string, value_date string, extra string"


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame([("f", "Europe/Berlin", "DMY", ";"), ("g", "UTC", "MDY", "\t"), (None, "UTC", "DMY", ",")], "feed string, tz_name string, date_order string, delimiter string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("CET", 60), (None, 5), ("", 7), ("X", None)], "label string, offset_min int")


def test_differences(spark, rows_of, feeds, labels):
    main = [
        ("f_1", 1, "REF-1", "1.234,50", "05/06/2024", "a"),
        ("f_1", 2, "REF-2", "5.00", "2024-06-05", "a"),
        ("f_1", 3, "REF-3", "x", "soon", "a"),
        ("f_1", 4, None, None, None, "a"),
        ("f_1", 5, "only", "1", "1", "a"),
        ("f_1", 6, "R", "1.00", "2023-03-26 02:30:00", "a"),
        (None, 7, "R", "1.00", None, "a"),
        ("f_1", None, "R", "1.00", None, "a"),
    ]
    copy = [
        ("f_1", 1, "ref 1", "1234.50", "2024-06-05", "b"),
        ("f_1", 1, "ref 1", "1234.50", "2024-06-05", "b"),
        ("f_1", 2, "REF-2X", "5.01", "2024-06-06", "b"),
        ("f_1", 3, "REF-3", "y", "soon", "b"),
        ("f_1", 4, "", None, "", "b"),
        ("f_1", 6, "R", "1,00", "2023-03-26T02:30:00", "b"),
        (None, 7, "R", "1.00", None, "b"),
        ("f_1", None, "R", "2.00", None, "b"),
        ("f_1", 9, "R", "2.00", None, "b"),
    ]
    empty = spark.createDataFrame([], "source_file string, source_row_number int, reason string")
    got = ledger_differences(spark.createDataFrame(main, RAW_COPY), spark.createDataFrame(copy, RAW_COPY), empty, empty, feeds, labels)
    want = [("raw_txn", "f_1", 2, d) for d in ("reference", "amount", "value_date")] + [("raw_txn", "f_1", 3, "amount"), ("raw_txn", "f_1", 4, "reference"), ("raw_txn", "f_1", 4, "value_date"), ("raw_txn", "f_1", 5, "missing_in_copy"), ("raw_txn", "f_1", 6, "value_date"), ("raw_txn", "f_1", 9, "missing_in_main"), ("raw_txn", "f_1", None, "amount")]
    assert rows_of(got) == sorted(want, key=repr)


def test_difference_values(spark):
    a = spark.createDataFrame([(1, "Open_Item", 1), (2, None, 1)], "k int, reason string, left_value int")
    b = spark.createDataFrame([(1, "open item", 2), (2, "x", 2), (2, "y", 2)], "k int, reason string, left_value int")
    got = diff_copies(a, b, ["k"], {"reason": by_column(reason_form)}).collect()
    assert sorted((r["k"], d["left_value"], d["right_value"]) for r in got for d in r["diffs"]) == [(2, None, "x"), (2, None, "y")]
    none = a.limit(0)
    assert diff_copies(none, none, ["k"], {"reason": by_column(reason_form)}).count() == 0
    assert [r["side"] for r in diff_copies(a, none, ["k"], {"reason": by_column(reason_form)}).collect()] == ["left", "left"]


def test_hot_key_in_copies(spark):
    a = spark.createDataFrame([("f", 1, "x")], "source_file string, row_number int, reason string")
    b = spark.range(20000).select(F.lit("f").alias("source_file"), F.lit(1).alias("row_number"), F.when(F.col("id") == 5, "y").otherwise("X ").alias("reason"))
    assert [tuple(r) for r in case_rows(diff_copies(a, b, ["source_file", "row_number"], {"reason": by_column(reason_form)}), "t", "row_number").collect()] == [("t", "f", 1, "reason")]


def test_timestamps(spark, rows_of, feeds, labels):
    data = [(1, "f_1", "05/06/2024", "2024-06-05 10:00:00 CET"), (2, "g_1", "05/06/2024", None), (3, "h_1", "05/06/2024", "2024-06-05"), (None, "f_2", "20240605", "9" * 100), (5, None, "20240605", "2024-06-05T00:00:00.000000Z"), (6, "f_1", "2024-10-27 02:30", "")]
    raw = spark.createDataFrame(data, "raw_id bigint, source_file string, value_date string, booking_date string").withColumn("norm", F.lit("clash")).withColumn("value", F.lit(1))
    got = changed_timestamps(raw, "raw_id", ["value_date", "booking_date"], feeds, labels)
    assert rows_of(got) == sorted([(1, "value_date", "2024-06-05"), (1, "booking_date", "2024-06-05T09:00:00.000000Z"), (2, "value_date", "2024-05-06"), (None, "value_date", "2024-06-05")], key=repr)
    assert changed_timestamps(raw.limit(0), "raw_id", ["value_date"], feeds, labels).count() == 0
    assert normalise_timestamps(raw, "raw_id", ["value_date", "booking_date"], feeds, labels).count() == 11


def test_dictionary_grows(spark, feeds, labels, tmp_path):
    path = str(tmp_path / "dictionary")
    known = InstantDictionary(feeds, labels, path)
    first = spark.createDataFrame([("f", "01/02/2024"), ("f", "01/02/2024"), ("f", None)], "_feed string, _value string")
    assert [(r["_key"], r["n"], r["norm"]) for r in known.update(first).collect()] == [("01/02/2024", 2, "2024-02-01")]
    second = first.unionByName(spark.createDataFrame([("g", "01/02/2024")], "_feed string, _value string"))
    assert sorted((r["_feed"], r["norm"]) for r in InstantDictionary(feeds, labels, path).update(second).collect()) == [("f", "2024-02-01"), ("g", "2024-01-02")]
    assert len(known._batches()) == 2 and known.stored().count() == 2
    assert len(known.update(second).collect()) == 2 and len(known._batches()) == 2  # nothing new, nothing parsed
    (Path(known.path) / "batch-broken").mkdir()
    assert known.stored().count() == 2
    other = InstantDictionary(feeds.where("feed = 'g'"), labels, path)  # other zones read otherwise
    assert other.path != known.path and other.stored().count() == 0


def line_of(fields, delimiter=";"):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="").writerow(fields)
    return out.getvalue()


LINES = {
    line_of(["R", "1.00", "EUR", "2024-01-15", "a;b \"c\"\nd", "", "n", ""]): None,
    '"R";"1.00";EUR;"15/01/2024";"";"""";x;': None,
    "R;1.00;EUR;2024-01-15;d;i;n": "MalformedRow",
    "R;1.00;EUR;2024-01-15;d;i;n;b;x": "MalformedRow",
    'R;1.00;EUR;2024-01-15;"d;i;n;b': "MalformedRow",
    'R;1.00;EUR;2024-01-15;"d"x;i;n;b': "MalformedRow",
    'R;1.00;EUR;2024-01-15;a"d";i;n;b': "MalformedRow",
    "R;1.00;EUR;2024-01-15;d\nd;i;n;b": "MalformedRow",
    "R,1.00,EUR,2024-01-15,d,i,n,b": "MalformedRow",
    "": "MalformedRow",
    None: "MalformedRow",
    "R;;EUR;2024-01-15;d;i;n;b": "InvalidAmount",
    "R;x;EUR;nope;d;i;n;b": "InvalidAmount",
    "R;1.00;EUR;nope;d;i;n;b": "InvalidDate",
    "R;1.00;EUR;;d;i;n;b": "InvalidDate",
    "R;1.00;EUR;2024-02-30;d;i;n;b": "InvalidDate",
    "R;1.00;EUR;2023-06-15T25:61:00;d;i;n;b": "InvalidDate",
    "R;1.00;EUR;2023-03-26 02:30:00;d;i;n;b": None,
    f"R; 12.50{' ' * 70};EUR;2024-01-15{' ' * 60};d;i;n;b": None,
    f"R;{'0' * 90}1.50;EUR;2024-01-15;d\x01e;i;n;b": None,
    f"R;{'9' * 500};EUR;2024-01-15;d;i;n;b": "InvalidAmount",
    f"R;1.00;EUR;{'9' * 500};d;i;n;b": "InvalidDate",
    f'R;1.00;EUR;2024-01-15;"{"x;" * 100_000}";i;n;whenever': None,
    f'R;1.00;EUR;2024-01-15;{chr(34) * 100_002};i;n;b': None,
}


def test_lines(spark, feeds, labels):
    raw = spark.createDataFrame([(i, "f_1.csv", i, x) for i, x in enumerate(LINES)] + [(99, "unknown", 1, "a;b"), (100, "g_1", 1, "R\t1.00\tEUR\t01/15/2024\td\ti\tn\tb")], "line_id bigint, source_file string, row_number int, line string").withColumn("reason", F.lit("clash")).withColumn("n", F.lit(3))
    lines = write_table(load_lines(raw, feeds, labels), "lines")
    assert {r["line_id"]: r["reason"] for r in lines.collect()} == dict(enumerate(LINES.values())) | {99: "MalformedRow", 100: None}
    first = lines.where("line_id = 0").first()
    assert (first["description"], first["iban"], first["value_at"], str(first["amount_value"])) == ('a;b "c"\nd', "", "2024-01-15", "1.00")
    assert lines.where("line_id = 1").first()["iban"] == '"'
    assert lines.where(F.col("description") == "d\x01e").count() == 1
    assert loaded_rows(lines).count() + row_errors(lines).count() == len(LINES) + 2
    assert load_lines(raw.limit(0), feeds, labels).count() == 0


def test_split_line_round_trip(spark):
    rng = random.Random(5)
    rows = [["".join(rng.choice('ab;"\n\x01\x02,') for _ in range(rng.randrange(6))) for _ in range(rng.randrange(2, 6))] for _ in range(300)]
    lines = [";".join('"' + f.replace('"', '""') + '"' if rng.random() < 0.5 or set(f) & set(';"\n') else f for f in r) for r in rows]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", split_line(F.col("line"), F.lit(";")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == rows


def test_lookup_of_hot_keys(spark, rows_of):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    dictionary = write_table(rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.concat(F.col("k"), F.lit("!"))), "test")
    assert [r["k"] for r in hot_keys(dictionary, most=10).collect()] == ["hot"]
    got = lookup(rows, dictionary, ["k"], ["v"], F.col("id"), most=10)
    assert rows_of(got) == rows_of(rows.withColumn("v", F.concat(F.col("k"), F.lit("!"))))
