"""Matching and classification against sequential brute force, and the cases of the data model."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyloom import ledgers
from tallyloom.functions.divisors import divisors
from tallyloom.operators import match_cells
from tallyloom.operators.classify import classify, reason_counts
from tallyloom.operators.match import match, match_exact, match_results, numbered, unmatched_sources, unmatched_targets
from tallyloom.operators.normalize import normalize
from tallyloom.operators.reconcile import error_rows, reconcile, summary
from tallyloom.options import ReconOptions, ToleranceRule
from tallyloom.plans.strategies import Exact, Fuzzy, Partial, default_pipeline, pipeline_from_names
from tallyloom.schemas import RAW
from tallyloom.tables import Tables

SHAPE = "ref string, currency string, ordinal bigint, amount decimal(18,2), value_date date"
DAY = date(2024, 3, 15)
O = ReconOptions()


def frame(spark, rows):
    return spark.createDataFrame([(r, c, o, D(str(a)) if a is not None else None, d) for r, c, o, a, d in rows], SHAPE)


def simple(spark, amounts, ref="A", start=0, currency="EUR", days=None):
    return frame(spark, [(ref, currency, start + i, a, DAY + timedelta(days[i] if days else 0)) for i, a in enumerate(amounts)])


def score(x, y):
    s = D("0.95") - abs(x[3] - y[3]) / D(5) * D("0.15") - D(abs((x[4] - y[4]).days)) / D(3) * D("0.10")
    return max(D("0.70"), min(D("0.95"), s))


def sequential(sources, targets, names):
    """Each source in turn, strategy by strategy, over the targets of its bucket in order."""
    claimed, pairs = set(), []
    for x in sorted(sources, key=lambda r: r[2]):
        pool = [y for y in sorted(targets, key=lambda r: r[2]) if y[:2] == x[:2] and y[2] not in claimed]
        for name in names:
            if name == "Exact":
                found = [y for y in pool if y[3] == x[3] and y[4] == x[4]]
            elif name == "Fuzzy":
                ok = lambda y: abs(x[3] - y[3]) <= 5 or (x[3] != 0 and abs(x[3] - y[3]) * 100 <= D("0.5") * abs(x[3]))
                found = sorted((y for y in pool if ok(y) and abs((x[4] - y[4]).days) <= 3), key=lambda y: -score(x, y))
            else:
                found = [y for y in pool if y[3] != 0 and abs(y[3]) < abs(x[3]) and abs(x[3]) % abs(y[3]) == 0]
            if found:
                claimed.add(found[0][2])
                pairs.append((x[2], found[0][2], name))
                break
    return sorted(pairs)


def random_rows(rng, n, start):
    return [(rng.choice("ABCD"), rng.choice(["EUR", "USD"]), start + i, D(rng.choice([100, 100, 101, 103, 200, 300, 50, "100.5"])), DAY + timedelta(rng.randrange(5))) for i in range(n)]


@pytest.mark.parametrize("names", [["Exact", "Fuzzy", "Partial"], ["Partial", "Exact"], ["Fuzzy"], ["Exact"]])
@pytest.mark.parametrize("fold_most", [4096, 0])
def test_cascade_equals_sequence(spark, names, fold_most, monkeypatch):
    monkeypatch.setattr(match_cells, "GROUP_ROWS", 15)
    rng = random.Random(7)
    s, t = random_rows(rng, 60, 0), random_rows(rng, 60, 1000)
    got = match(frame(spark, s), frame(spark, t), O, pipeline_from_names(names), fold_most).select("s_ordinal", "t_ordinal", "strategy").collect()
    assert sorted(map(tuple, got)) == sequential(s, t, names)


def test_exact_closed_form(spark, rows_of):
    rng = random.Random(3)
    s, t = frame(spark, random_rows(rng, 80, 0)), frame(spark, random_rows(rng, 80, 1000))
    assert rows_of(match_exact(s, t), "s_ordinal", "t_ordinal", "score") == rows_of(match(s, t, O, [Exact()]), "s_ordinal", "t_ordinal", "score")


def test_numbering_in_stretches(spark, rows_of):
    rng = random.Random(4)
    rows = frame(spark, [(rng.choice(["A", "A", None]), "EUR", i * 3, 5, DAY) for i in rng.sample(range(500), 200)])
    assert rows_of(numbered(rows, ["ref", "currency"], 20), "ordinal", "ref", "n") == rows_of(numbered(rows, ["ref", "currency"]), "ordinal", "ref", "n")


@pytest.mark.parametrize(
    ("source", "targets", "want"),
    [(500, [500, 504], ("Exact", 0)), (500, [503], ("Fuzzy", 0)), (900, [300], ("Partial", 0)), (99999, [100000.5], ("Fuzzy", 0)), (99999, [100], None), (1000, [1004, 1001], ("Fuzzy", 1)), (900, [1000], None), (900, [0], None), (900, [400], None), (-900, [-300], ("Partial", 0))],
)
def test_cases(spark, source, targets, want):
    got = match(simple(spark, [source]), simple(spark, targets, start=100)).collect()
    assert [(r["strategy"], r["t_ordinal"] - 100) for r in got] == ([want] if want else [])


def test_contention_and_currency(spark):
    pairs = match(simple(spark, [500] * 50), simple(spark, [500], start=100))
    assert [(r["s_ordinal"], r["score"]) for r in pairs.collect()] == [(0, D("1.0000"))]
    assert unmatched_sources(simple(spark, [500] * 50), pairs).count() == 49
    assert match(simple(spark, [500]), simple(spark, [500], start=100, currency="USD")).count() == 0


def test_custom_strategy(spark):
    class SameDay:
        name = "SameDay"

        def eligible(self, x, y, options):
            return x["date"] == y["date"]

        def preference(self, x, y, options):
            return F.lit(0)

        def score(self, x, y, options):
            return F.lit(0.5)

    got = match(simple(spark, [1, 2]), simple(spark, [7, 8], start=10), O, [SameDay()]).orderBy("s_ordinal").collect()
    assert [(r["s_ordinal"], r["t_ordinal"], r["strategy"]) for r in got] == [(0, 10, "SameDay"), (1, 11, "SameDay")]


def test_pipelines():
    assert [s.name for s in pipeline_from_names(["Fuzzy", "Nothing", "Exact"])] == ["Fuzzy", "Exact"]
    assert [s.name for s in pipeline_from_names(["Nothing"], "Unknown")] == [s.name for s in default_pipeline()]
    assert isinstance(pipeline_from_names(None)[1], Fuzzy) and isinstance(pipeline_from_names([])[2], Partial)


def test_nulls_and_empty(spark):
    s = frame(spark, [(None, "EUR", 1, 5, DAY), ("A", None, 2, 5, DAY), ("A", "EUR", 3, None, DAY), ("A", "EUR", 4, 5, None)])
    t = frame(spark, [("A", "EUR", 10, 5, DAY), (None, None, 11, 5, DAY)])
    for most in (4096, 0):
        assert [(r["s_ordinal"], r["strategy"]) for r in match(s, t, O, None, most).collect()] == []
    empty = frame(spark, [])
    assert match(empty, empty).count() == 0 and match(s, t, O, []).count() == 0
    assert classify(empty, empty).count() == 0
    assert sorted(r["reason"] for r in classify(s, t).collect()) == ["ConsolidatedPayment", *["DuplicateInSource"] * 3, "MissingInSource", "MissingInTarget"]
    assert {r["kind"] for r in match_results(s, match(s, t)).collect()} == {"Unmatched"}


def classified(s, t, pairs):
    """The phases one after another, over lists of (ref, amount, date, id)."""
    out, sc, tc = {}, Counter(r[0] for r in s), Counter(r[0] for r in t)
    legs_s, legs_t = sc + Counter(p[0] for p in pairs), tc + Counter(p[1] for p in pairs)
    by_ref = defaultdict(list)
    for r in t:
        by_ref[r[0]].append(r)
    for r in s:
        if sc[r[0]] > 1:
            out[r[3]] = "DuplicateInSource"
    for r in t:
        if tc[r[0]] > 1:
            out[r[3]] = "DuplicateInTarget"
    for r in s:
        if r[3] not in out and legs_s[r[0]] == 1 and legs_t[r[0]] > 1:
            out[r[3]] = "SplitPayment"
    for r in t:
        if r[3] not in out and legs_s[r[0]] > 1 and legs_t[r[0]] == 1:
            out[r[3]] = "ConsolidatedPayment"
    for r in s:
        if r[3] not in out:
            free = [y for y in by_ref[r[0]] if y[3] not in out]
            near = min(free, key=lambda y: abs(y[1] - r[1])) if free else None
            out[r[3]] = "MissingInTarget" if near is None or (near[1] == r[1] and near[2] == r[2]) else "AmountMismatch" if near[1] != r[1] else "DateMismatch"
    for r in t:
        out.setdefault(r[3], "MissingInSource")
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classifier_equals_phases(spark, seed):
    rng = random.Random(seed)
    refs = [f"R{i}" for i in range(120)]
    make = lambda n, start: [(rng.choice(refs), D(rng.choice([100, 200])), DAY + timedelta(rng.randrange(2)), start + i) for i in range(n)]
    s, t = make(90, 0), make(90, 1000)
    pairs = [(rng.choice(refs), rng.choice(refs)) for _ in range(40)]
    as_frame = lambda rows: frame(spark, [(r, rng.choice(["EUR", "USD"]), o, a, d) for r, a, d, o in rows])
    got = classify(as_frame(s), as_frame(t), spark.createDataFrame(pairs, "s_ref string, t_ref string"))
    assert {r["ordinal"]: r["reason"] for r in got.collect()} == classified(s, t, pairs)


@pytest.mark.parametrize(
    ("s", "t", "matched", "want"),
    [
        ([100, 100], [], 0, {"DuplicateInSource": 2}),
        ([900], [300, 600], 0, {"SplitPayment": 1, "DuplicateInTarget": 2}),
        ([], [600], 1, {"MissingInSource": 1}),
        ([300, 600], [300, 600], 0, {"DuplicateInSource": 2, "DuplicateInTarget": 2}),
        ([300, 600], [900], 0, {"ConsolidatedPayment": 1, "DuplicateInSource": 2}),
        ([100], [150], 0, {"AmountMismatch": 1, "MissingInSource": 1}),
        ([100], [], 0, {"MissingInTarget": 1}),
        ([], [], 1, {}),
    ],
)
def test_classifier_cases(spark, s, t, matched, want):
    pairs = spark.createDataFrame([("A",)] * matched, "ref string")
    assert {r["reason"]: r["n"] for r in reason_counts(classify(simple(spark, s), simple(spark, t, start=100), pairs)).collect()} == want


def test_dates_in_classifier(spark):
    got = classify(simple(spark, [100]), simple(spark, [100], start=10, days=[5]))
    assert {r["ordinal"]: r["reason"] for r in got.collect()} == {0: "DateMismatch", 10: "MissingInSource"}


def test_ledger_totals(spark):
    s, t = ledgers.ledgers(Tables(spark, "/root/testdata/sf0.001").orders)
    pairs = match(s, t)
    assert Counter(r["strategy"] for r in pairs.collect()) == {"Exact": 788, "Fuzzy": 150, "Partial": 16}
    left = classify(unmatched_sources(s, pairs).drop("reason"), unmatched_targets(t, pairs), pairs)
    want = {"DuplicateInSource": 224, "DuplicateInTarget": 150, "SplitPayment": 75, "ConsolidatedPayment": 75, "AmountMismatch": 97, "DateMismatch": 75, "MissingInTarget": 150, "MissingInSource": 284}
    assert {r["reason"]: r["n"] for r in reason_counts(left).collect()} == want
    one = summary(s, t, pairs).first()
    assert (one["total_source"], one["matched"], one["unmatched_target"], one["match_rate"]) == (1575, 954, 1463 - 954, D("60.57"))


def raw(spark, *rows):
    base = {"reference": "REF-1", "amount": "10.00", "currency": "EUR", "value_date": "2024-01-15", "description": None, "iban": None, "counterparty_name": None, "booking_date": None, "source_file": "a.csv"}
    return spark.createDataFrame([tuple((base | {"row_number": i} | r).get(f) for f in RAW.fieldNames()) for i, r in enumerate(rows)], RAW)


def test_rejects_in_order(spark):
    good, bad = normalize(raw(spark, {}, {"reference": " ", "amount": None}, {"amount": None}, {"currency": ""}, {"value_date": "\t"}, {"amount": "x", "value_date": "y"}, {"value_date": "y"}, {"reference": "-/"}, {"currency": "EURO"}, {"booking_date": "never"}))
    assert sorted(r["source_row_number"] for r in good.collect()) == [0, 9]
    assert [r["error_message"] for r in bad.orderBy("error_row").collect()] == ["Reference is required.", "Amount is required.", "Currency is required.", "ValueDate is required.", "Cannot parse amount 'x'.", "Cannot parse date 'y'.", "Normalization failed: reference is empty.", "Normalization failed: currency has not three characters."]


def test_end_to_end(spark, tmp_path):
    report = reconcile(raw(spark, {}, {"reference": "ref 2", "amount": "x"}, {"reference": "R3"}), raw(spark, {"amount": "12,00"}, {"reference": "R4"}))
    assert report.status == "PartiallyCompleted"
    assert [r["strategy"] for r in report.pairs.collect()] == ["Fuzzy"]
    assert sorted(r["reason"] for r in report.unmatched.collect()) == ["MissingInSource", "MissingInTarget"]
    report.write(str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "summary")).first()["skipped_rows"] == 1


def test_options_change_matches(spark):
    wide = ReconOptions(tolerance=ToleranceRule(1000, 10, 30))
    assert match(simple(spark, [100]), simple(spark, [600], start=5), wide).count() == 1
    assert match(simple(spark, [100]), simple(spark, [101], start=5), ReconOptions(tolerance=ToleranceRule.strict())).count() == 0


def outcomes(report):
    """Every row of a report by side, file and row number, with what became of it."""
    found = Counter()
    for r in report.unmatched.collect():
        found[r["side"], r["source_file"], r["source_row_number"], r["reason"]] += 1
    for side, kept in (("S", report.sources), ("T", report.targets)):
        by = {r["ordinal"]: r for r in kept.collect()}
        for p in report.pairs.collect():
            r = by[p[f"{side.lower()}_id"]]
            found[side, r["source_file"], r["source_row_number"], p["strategy"]] += 1
    return found


def test_row_numbers_repeat_between_files(spark):
    s = raw(spark, {"source_file": "a", "row_number": 1}, {"source_file": "b", "row_number": 1, "reference": "other"})
    t = raw(spark, {"source_file": "a", "row_number": 1}, {"source_file": "c", "row_number": 1, "reference": "third"})
    report = reconcile(s, t)
    assert outcomes(report) == Counter({("S", "a", 1, "Exact"): 1, ("S", "b", 1, "MissingInTarget"): 1, ("T", "a", 1, "Exact"): 1, ("T", "c", 1, "MissingInSource"): 1})
    assert {r["reason"]: r["n"] for r in report.reasons.collect()} == {"MissingInTarget": 1, "MissingInSource": 1}


@pytest.mark.parametrize("number", [None, 7])
def test_rows_without_own_numbers_are_kept_apart(spark, number):
    rows = [{"row_number": number, "amount": f"{a}.00"} for a in (10, 10, 500, 900)]
    told = []
    report = reconcile(raw(spark, *rows), raw(spark, *rows[:3], {"row_number": number, "amount": "x"}), watch=told.append)
    one = report.summary.first()
    assert (one["total_source"], one["total_target"], one["matched"], one["unmatched_source"], one["skipped_rows"], one["dead_letter_files"]) == (4, 3, 3, 1, 1, 1)
    assert report.unmatched.count() == 1 and report.pairs.select("s_id").distinct().count() == 3
    assert [(p.step, p.percent) for p in told] == [("normalize", 33.33), ("match", 66.67), ("classify", 100.0)]
    assert error_rows(report.rejects).first()["error_type"] == "InvalidAmount"


def test_ids_decide_in_a_match(spark):
    shape = "txn_id string, " + SHAPE
    s = spark.createDataFrame([("s1", "A", "EUR", 1, D(5), DAY), ("s2", "B", "EUR", 1, D(5), DAY), ("s3", "A", "EUR", None, D(7), DAY)], shape)
    t = spark.createDataFrame([("t1", "A", "EUR", 1, D(5), DAY), ("t2", "A", "EUR", 1, D(7), DAY)], shape)
    for most in (4096, 0):
        pairs = match(s, t, fold_most=most)
        assert sorted((r["s_id"], r["t_id"]) for r in pairs.collect()) == [("s1", "t1"), ("s3", "t2")]
        assert [r["txn_id"] for r in unmatched_sources(s, pairs).collect()] == ["s2"] and unmatched_targets(t, pairs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_large_bucket_in_rounds(spark, seed, monkeypatch):
    """A contended bucket cut into cells, with amounts and dates that overlap from cell to cell, takes turns as one."""
    monkeypatch.setattr(match_cells, "GROUP_ROWS", 20)
    monkeypatch.setattr(match_cells, "BLOCK", (1, 1))
    rng = random.Random(seed)
    make = lambda n, start: [("A", "EUR", start + i, D(rng.choice([rng.randrange(900, 1100), rng.randrange(-300, 300), 5, 50, 1000])) + D(rng.choice(["0", "0.50"])), DAY + timedelta(rng.randrange(9))) for i in range(n)]
    s, t = make(150, 0), make(140, 1000)
    s += [("A", "EUR", 200 + i, D("77.70"), DAY) for i in range(20)]
    t += [("A", "EUR", 2000 + i, D("77.70"), DAY) for i in range(15)]
    got = match(frame(spark, s), frame(spark, t), O, None, 0).select("s_ordinal", "t_ordinal", "strategy").collect()
    assert sorted(map(tuple, got)) == sequential(s, t, ["Exact", "Fuzzy", "Partial"])
    odd = ReconOptions(tolerance=ToleranceRule(0, 2, 0))
    folded = match(frame(spark, s), frame(spark, t), odd).select("s_ordinal", "t_ordinal", "strategy", "score").collect()
    cells = match(frame(spark, s), frame(spark, t), odd, None, 0).select("s_ordinal", "t_ordinal", "strategy", "score").collect()
    assert sorted(map(tuple, folded)) == sorted(map(tuple, cells))


def test_divisors():
    rng = random.Random(1)
    for n in [0, 1, 2, 9973 * 9967, 999983 * 999979, 10**12, *(rng.randrange(1, 5000) for _ in range(50))]:
        found = divisors(n)
        assert len(found) == len(set(found)) and all(n % d == 0 for d in found)
        assert n > 5000 or sorted(found) == [d for d in range(1, n + 1) if n % d == 0]


def test_any_session_zone(spark, rows_of):
    rows = raw(spark, {"value_date": "2024-01-15"}, {"value_date": "2024-01-15T23:30:00"}, {"value_date": "15 Jan 2024"}, {"value_date": "2024-01-15 23:30"}, {"value_date": "2024-01-15T01:00:00+02:00"})
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        got = normalize(rows)[0].select("source_row_number", F.col("value_date").cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(tuple, got)) == [(0, "2024-01-15"), (1, "2024-01-15"), (2, "2024-01-15"), (3, "2024-01-15"), (4, "2024-01-14")]
