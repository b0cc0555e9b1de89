"""Files in and out, a stream of both sides, and the registered queries on the smallest tables."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from tallyloom import queries
from tallyloom.schemas import RAW
from tallyloom.sources.files import FileTooLargeError, batches, page, read_raw, results
from tallyloom.streaming.matching import match_stream, normalize_stream

ROOT = Path(__file__).resolve().parents[1]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('reference,amount,currency,value_date,description,iban,counterparty_name,booking_date,row_number,source_file\nR1,"1,00",EUR,2024-01-15,"a ""b""",,,,1,\n')
    good, bad = read_raw(spark, str(tmp_path / "a.csv"), "Csv")
    row = good.first()
    assert (row["amount"], row["description"], row["source_file"], row["iban"]) == ("1,00", 'a "b"', "a.csv", None)
    (tmp_path / "b.json").write_text(json.dumps({"reference": "R", "amount": "1", "other": 2}) + "\n{broken\n")
    good, bad = read_raw(spark, str(tmp_path / "b.json"), "Json")
    assert [r["reference"] for r in results(good)] == ["R"]
    assert [r["record"] for r in bad.collect()] == ["{broken"]
    with pytest.raises(FileTooLargeError):
        read_raw(spark, str(tmp_path / "b.json"), "Json", max_file_bytes=3)
    with pytest.raises(ValueError):
        read_raw(spark, str(tmp_path), "Xml")


def test_rows_of_files_are_numbered(spark, tmp_path):
    head = "reference,amount,currency,value_date,description,iban,counterparty_name,booking_date\n"
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f"R{i},{i}.00,EUR,2024-01-15,,,,\n" for i in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        good, _ = read_raw(spark, str(tmp_path), "Csv")
        rows = good.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["source_file"], r["row_number"]) for r in rows) == [(f"{n}.csv", i) for n in "ab" for i in range(1, 2001)]
    assert all(r["reference"] == f"R{r['row_number']}" for r in rows)
    assert [len(b) for b in batches(good.limit(25), 10)] == [10, 10, 5]
    assert [r["row_number"] for r in page(good, ["source_file", "row_number"], 3, 5).collect()] == [11, 12, 13, 14, 15]


def test_mt940(spark, tmp_path):
    (tmp_path / "s.sta").write_text(":20:X\n:25:BANK/DE001234\n:28C:1/1\n:60F:C240101EUR100,00\n:61:2401150116C12,50NTRFREF1//B\n:86:Payment\nfor rent\n:61:240116D7,NTRFREF2\n:86:Fee\n:61:broken\n:62F:C240131EUR105,50\n-\n")
    good, bad = read_raw(spark, str(tmp_path), "Mt940", max_file_bytes=10_000)
    rows = sorted(good.collect(), key=lambda r: r["row_number"])
    assert [(r["reference"], r["amount"], r["currency"], r["value_date"], r["description"], r["booking_date"]) for r in rows] == [("REF1", "12,50", "EUR", "20240115", "Payment for rent", "20240116"), ("REF2", "-7,", "EUR", "20240116", "Fee", None)]
    assert bad.count() == 1


def test_stream(spark, tmp_path):
    shape = "side string, ref string, currency string, ordinal bigint, amount decimal(18,2), value_date date"
    day = __import__("datetime").date(2024, 1, 15)
    source = tmp_path / "in"
    batches = [[("T", "A", "EUR", 10, 5, day), ("T", "A", "EUR", 11, 7, day)], [("S", "A", "EUR", 1, 5, day), ("S", "A", "EUR", 2, 8, day), ("S", "B", "EUR", 3, 8, day)], [("S", "A", "EUR", 4, 5, day)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(a, b, c, o, __import__("decimal").Decimal(x), d) for a, b, c, o, x, d in rows], shape).coalesce(1).write.parquet(str(source / f"b{i}"))
        stream = spark.readStream.schema(shape).option("recursiveFileLookup", True).parquet(str(source))
        query = match_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("s_ordinal", "t_ordinal", "strategy").collect())
    assert found == [(1, 10, "Exact"), (2, 11, "Fuzzy")]
    (tmp_path / "raw").mkdir()
    good, bad = normalize_stream(spark.readStream.schema(RAW).json(str(tmp_path / "raw")), "S")
    assert good.isStreaming and bad.isStreaming


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p5_loaded", "norm_full", "match_results", "reconcile_end_to_end"])
def test_queries_run(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_sql_names_are_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_core_does_not_need_the_subpackage():
    code = "import sys; sys.modules['tallyloom.llm'] = None; import __spark_entry__ as e; assert not any(k in e.queries() for k in ('p3_found', 'p9_found')); assert 'p1_found' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    for path in (ROOT / "tallyloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tallyloom.llm" not in path.read_text(), path
