"""Each operator against brute force or an exact round trip, with nulls, ties, repeats, empty tables and clashing columns."""

import base64
import quopri
import random
from collections import Counter, defaultdict
from datetime import UTC, datetime, timedelta
from decimal import Decimal as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import languages, queries
from tallyloom.llm.entity_match import matched_entries, propagate
from tallyloom.llm.format_copies import record_copies, records
from tallyloom.llm.languages import code_of, document_languages, language_findings, sentences
from tallyloom.llm.leakage import Hasher, leaked_items, rolling, shared_runs, tile, tiled, words_of
from tallyloom.llm.mail import text_bodies
from tallyloom.llm.name_parts import abbreviates, name_words, one_edit
from tallyloom.llm.name_variants import name_entities, name_pairs, soft_similarity
from tallyloom.llm.name_words import close_words, parsed_names, word_meanings
from tallyloom.llm.nearest_time import nearest_in_time
from tallyloom.llm.packing import _encoder, VOCABULARY, container_fill, pack_documents, pack_histogram
from tallyloom.plans.components import connected_components
from tallyloom.tables import Tables

RAW = "raw_id bigint, reference string, amount string, currency string, value_date string, description string, iban string, counterparty_name string, booking_date string"


def raw_rows(spark, *rows):
    base = {"reference": "INV-1", "amount": "10.00", "currency": "EUR", "value_date": "2024-01-01", "description": "INV:1; PO:2", "iban": None, "counterparty_name": "A", "booking_date": None}
    cols = [c.split()[0] for c in RAW.split(", ")]
    return spark.createDataFrame([tuple(({"raw_id": i} | base | r).get(c) for c in cols) for i, r in enumerate(rows)], RAW).withColumn("key", F.lit(1)).withColumn("n", F.lit(1))


def test_formatting_copies(spark, rows_of):
    raw = raw_rows(
        spark, {}, {"reference": "inv 1", "description": "po=2 / inv=1"}, {"amount": "10,00"}, {"description": "INV:2; PO:1"}, {"amount": "x"}, {"amount": None}, {"iban": ""}, {"value_date": "2024-01-01 "}, {"raw_id": None},
        {"description": None}, {"description": None, "currency": " eur"}, {"description": "seed delivery"}, {"description": "delivery seed"}, {"description": "Seed-DELIVERY."}, {"description": "x" * 200_000}, {"description": "X" * 200_000},
    )
    assert sorted(rows_of(record_copies(raw))) == [(0, 1), (0, 2), (9, 10), (11, 13), (14, 15)]
    assert dict(rows_of(records(raw)))[0] == 3
    assert record_copies(raw.limit(0)).count() == 0


def test_hot_record(spark):
    raw = spark.range(5000).select(F.col("id").alias("raw_id"), F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("R"), F.floor(F.col("id") / 2))).alias("reference"), F.lit("1.00").alias("amount"), *[F.lit(None).cast("string").alias(c) for c in ("currency", "value_date", "description", "iban", "counterparty_name", "booking_date")])
    got = {(r[0], r[1]) for r in record_copies(raw).collect()}
    rows, first = raw.select("raw_id", "reference").orderBy("raw_id").collect(), {}
    assert got == {(first[r[1]], r[0]) for r in rows if first.setdefault(r[1], r[0]) != r[0]}


def nearest_brute(s, t, tol):
    best = []
    for k, at, o in s:
        near = sorted((abs(u - at), p) for j, u, p in t if j == k and j is not None and u is not None and at is not None and abs(u - at) <= tol)
        if near:
            best.append((o, near[0][1]))
    return sorted(best)


@pytest.mark.parametrize("hot_rows", [20_000, 30])
def test_nearest_times(spark, rows_of, hot_rows):
    rng = random.Random(hot_rows)
    begin = datetime(2024, 1, 1, tzinfo=UTC)
    make = lambda n, start: [(rng.choice(["HOT", "HOT", "B", "C", None]), rng.choice([None, *[rng.randrange(40_000) for _ in range(9)]]), start + i) for i in range(n)]
    s, t = make(400, 0), make(400, 1000)
    t += [(k, a, o + 5000) for k, a, o in t[:60]]
    s += s[:3]
    frame = lambda rows: spark.createDataFrame([(k, None if a is None else begin + timedelta(seconds=a), o, "x") for k, a, o in rows], "ref string, value_ts timestamp, ordinal bigint, c string")
    got = rows_of(nearest_in_time(frame(s), frame(t), "ref", "value_ts", "ordinal", 1800, hot_rows))
    assert sorted(got) == nearest_brute(s, t, 1800)
    assert nearest_in_time(frame(s), frame([]), "ref", "value_ts", "ordinal").count() == 0
    assert nearest_in_time(frame([]), frame(t), "ref", "value_ts", "ordinal").count() == 0


def test_packing_histogram():
    rng = random.Random(1)
    for _ in range(30):
        lengths = Counter(rng.choice([rng.randrange(1, 65), rng.randrange(1, 12), 64]) for _ in range(rng.randrange(1, 400)))
        packed = pack_histogram(dict(lengths), 64)
        placed = Counter()
        for n, pattern in packed:
            assert sum(length * k for length, k in pattern.items()) <= 64
            for length, k in pattern.items():
                placed[length] += n * k
        assert placed == lengths
        least = -(-sum(k * n for k, n in lengths.items()) // 64)
        assert sum(n for n, _ in packed) <= 1.3 * least + 2


def test_packing_round_trip(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["pay", "invoice", "7", "\n"]) for _ in range(rng.randrange(0, 150))) for i in range(300)} | {300: "word " * 5000, 301: "", 302: None, 303: "x" * 50_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("length", F.lit(1)).withColumn("container", F.lit(2))
    packed = pack_documents(docs, capacity=128).toPandas()
    enc = _encoder(VOCABULARY)
    for i, text in texts.items():
        own = packed[packed["doc_id"] == i].sort_values("piece")
        if text is None:
            assert own.empty
            continue
        n = len(enc.encode_ordinary(text))
        assert own["start_token"].tolist() == list(range(0, max(n, 1), 128)) and own["end_token"].max() == n
        assert len(own) == 1 or n > 128
    sums = (packed["end_token"] - packed["start_token"]).groupby(packed["container"]).sum()
    assert sums.max() <= 128 and sorted(sums.index) == list(range(len(sums)))
    assert len(sums) <= 1.03 * (packed["end_token"] - packed["start_token"]).sum() / 128 + 1
    assert pack_documents(docs.limit(0)).count() == 0
    assert container_fill(pack_documents(docs.where("doc_id = 301"), capacity=128)).collect()[0]["tokens"] == 0


def test_bodies():
    body = "Grüße an alle,\n> zitiert"
    b64 = base64.encodebytes(body.encode()).decode()
    qp = quopri.encodestring(body.encode()).decode()
    head = "From: a@b.example\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: "
    assert text_bodies(f"{head}base64\n\n{b64}") == [body]
    assert text_bodies(f"{head}quoted-printable\n\n{qp}") == [body]
    assert text_bodies(f"{head}8bit\r\n\r\n{body}") == [body]
    multi = f'From: a\nContent-Type: multipart/mixed;\n boundary="x=1"\n\npreamble\n--x=1\nContent-Type: text/html\n\n<p>a<b>b</b>c &amp; d<br>e</p><style>no</style>\n--x=1\nContent-Type: text/plain\nContent-Disposition: attachment\n\nsecret\n--x=1\n\nplain'
    assert [" ".join(x.split()) for x in text_bodies(multi)] == ["abc & d e", "plain"]
    assert text_bodies("no headers here") == ["no headers here"]
    deep = f"{head}8bit\n\nfound"
    for i in range(60):
        deep = f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n{deep}\n--b{i}--\n" if i % 2 else f"Content-Type: message/rfc822\n\n{deep}"
    assert [x.strip() for x in text_bodies(deep)] == ["found"]
    assert text_bodies(None) == [] and text_bodies("") == []
    assert text_bodies(f"{head}base64\n\n%%%")[0] == ""


def brute_leaks(docs, items, k):
    found = set()
    for d, text in docs:
        bodies = [words_of(b) for b in text_bodies(text)]
        for i, item in items:
            w = words_of(item)
            runs = {tuple(w[x : x + k]) for x in range(len(w) - k + 1)}
            if any(tuple(b[x : x + k]) in runs for b in bodies for x in range(len(b) - k + 1)):
                found.add((d, i))
    return found


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(f"I{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40)))) for i in range(25)] + [("N", None), ("E", ""), (None, "w1 " * 20)]
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(vocabulary) for _ in range(40))
        if rng.random() < 0.6:
            source = items[rng.randrange(25)][1].split()
            at = rng.randrange(len(source))
            text += "\n> " + ", ".join(source[at : at + rng.randrange(4, 16)]).upper() + " end"
        docs.append((i, text))
    docs += [(900, None), (901, ""), (902, "w1 w2 " * 40_000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    known = spark.createDataFrame(items, "item_id string, text string")
    for k in (4, 12):
        got = leaked_items(frame, known, min_tile=k, min_run=k)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute_leaks([d for d in docs if d[1] is not None], [i for i in items if i[0] and i[1]], k)
    assert leaked_items(frame.limit(0), known).count() == 0 and leaked_items(frame, known.limit(0)).count() == 0


def test_reordered_passage(spark):
    words = [f"u{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[20:29] + ["x"] + words[:9] + ["y"] + words[30:39])), (2, " ".join(words[:9]))], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    got = leaked_items(docs, items, min_tile=6, min_run=12, min_coverage=0.5).collect()
    assert [(r["doc_id"], r["longest"], r["covered"], r["tiles"]) for r in got] == [(1, 9, 27, 3)]
    assert leaked_items(docs, items).count() == 0
    twice = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1"))
    assert leaked_items(twice, items.unionByName(items), min_tile=6, min_run=9).count() == 2


def test_tiles_do_not_overlap():
    rng = random.Random(8)
    for _ in range(100):
        item = np.array([rng.randrange(1, 4) for _ in range(30)])
        doc = np.array([rng.randrange(1, 4) for _ in range(40)])
        seeds = [(d, i) for d in range(38) for i in range(28) if (doc[d : d + 3] == item[i : i + 3]).all()]
        tiles = tile(seeds, doc, item, 3)
        for side in (0, 1):
            cells = [x for t in tiles for x in range(t[side], t[side] + t[2])]
            assert len(cells) == len(set(cells))
        assert all((doc[d : d + n] == item[i : i + n]).all() for d, i, n in tiles)
        assert not seeds or max(t[2] for t in tiles) == max(next(n for n in range(40, 2, -1) if any((d + n <= 40 and i + n <= 30 and (doc[d : d + n] == item[i : i + n]).all()) for d, i in seeds)) for _ in (0,))
    assert len(rolling(Hasher()(["x", "y"]), 3)) == 0 and shared_runs(["a", "b"], ["a", "b"], 2) == [(0, 0)]
    assert tiled([["a", "b", "c"], ["d", "e"]], ["d", "e", "a", "b", "c"], 2) == (3, 5, 2, 1.0)


LINES = {
    "en": ["the bank says that the payment left their system on monday", "could you send me a copy of the statement and tell me who approved it", "we still cannot find the invoice that your office mentioned"],
    "de": ["die bank sagt dass die zahlung ihr system am montag verlassen hat", "könnten sie mir eine kopie schicken und sagen wer das freigegeben hat", "wir können das dokument das ihr büro erwähnt hat nicht finden"],
    "fr": ["la banque dit que le paiement a quitté son système lundi", "pourriez vous me envoyer une copie et me dire qui a validé la facture", "nous ne trouvons toujours pas le document dont votre bureau a parlé"],
    "es": ["el banco dice que el pago salió de su sistema el lunes", "podría enviarme una copia y decirme quién aprobó el informe en su equipo", "todavía no encontramos el documento que su oficina mencionó"],
    "it": ["la banca dice che il pagamento è uscito dal loro sistema lunedì", "potrebbe mandarmi una copia e dirmi chi ha approvato la fattura da voi", "non riusciamo ancora a trovare il documento che il vostro ufficio ha citato"],
    "nl": ["de bank zegt dat de betaling op maandag hun systeem heeft verlaten", "kunt u mij een kopie sturen en zeggen wie de factuur heeft goedgekeurd", "we kunnen het stuk dat uw kantoor noemde nog steeds niet vinden"],
}


def test_languages(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(600):
        main, other = rng.sample(list(LINES), 2)
        text = [rng.choice(LINES[main]).capitalize() + "." for _ in range(5)]
        label = rng.choice([main] * 6 + [other, None, "und", {"en": "eng", "de": "de-DE"}.get(main, main.upper())])
        if mixed := rng.random() < 0.3:
            text.insert(2, rng.choice(LINES[other]).capitalize() + ".")
            want.add((i, other, "part"))
        if code_of(label) != main:
            want.add((i, main, "main"))
        rows.append((i, label, " ".join(text) if not mixed else "\n\n".join(text)))
    rows += [(700, "en", None), (701, None, ""), (702, "xx", "12 34"), (703, "en", "the bank says that the payment left their system on monday. " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("kind", F.lit("clash"))
    found = document_languages(docs)
    assert {tuple(r) for r in language_findings(found).where("doc_id <> 702").collect()} == want
    assert {r["doc_id"]: r["confidence"] for r in found.where("doc_id in (700, 701) and lang is null").collect()} == {700: 0.0, 701: 0.0}
    assert document_languages(docs.limit(0)).count() == 0
    assert [code_of(x) for x in ("en-GB", "DEU", " fr ", "und", "", None, "xx")] == ["en", "de", "fr", None, None, None, None]
    assert len(sentences(["> a b.\n> c\n\nd e: f", "-----Original Message-----\nFrom: x y\n\nz"])) == 4


def test_name_words():
    assert name_words("Stiwohazovu Trspt B.V.") == (["stiwohazovu", "trspt"], [], "bv") and name_words("BESLOTEN VENNOOTSCHAP Stiwohazovu & Sons")[2] == "bv"
    assert name_words("Dr Bob J. Gawuféplawu") == (["bob", "gawufeplawu"], ["j"], "")
    assert name_words("B.") == (["b"], [], "") and name_words("Ges. mbH Kappa Int'l") == (["kappa", "intl"], [], "gmbh")
    assert all(name_words(x) is None for x in ("-", "UNKNOWN", "n/a", "", None, "123"))
    assert name_words("x" * 100_000)[0] == ["x" * 100_000]
    assert [one_edit("abcd", x) for x in ("abcd", "abdc", "abc", "abcde", "axcd", "abxy", "bacd", "dbca")] == [True, True, True, True, True, False, True, False]
    assert one_edit("x" * 1_000_000, "x" * 999_999 + "y")
    assert [abbreviates(*x) for x in (("softw", "software"), ("tom", "thomas"), ("rossi", "rossini"), ("bob", "robert"), ("chmcl", "chemicals"))] == [True, True, False, False, True]
    assert soft_similarity([("keller", 5.0), ("gertrude", 3.0)], [("keller", 5.0), ("thomas", 3.0)]) < 0.5 < 0.8 < soft_similarity([("keller", 5.0), ("tom", 3.0)], [("keller", 5.0), ("thomas", 3.0)])


def test_close_words(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 13))) for _ in range(300)}
    got = {(r["a"], r["b"]) for r in close_words(spark.createDataFrame([(c,) for c in sorted(words)], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and min(len(a), len(b)) >= 4 and one_edit(a, b)}


def made_names(rng, persons, firms, given, trades):
    """Groups of spellings of invented parties, from short forms and abbreviations that no list of the library holds."""
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s"])
    word = lambda: "".join(syllable() for _ in range(4)).capitalize()

    def typo(w):
        i = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "x" + w[i + 1 :]])

    groups, houses = [], []
    for _ in range(persons):
        name, house = rng.choice(sorted(given)), word()
        twin = houses and rng.random() < 0.05
        if twin:
            name, house = next((g, h) for g, h in ((rng.choice(sorted(given)), h) for h in iter(lambda: rng.choice(houses)[1], None)) if (g, h) not in houses)
        houses.append((name, house))
        forms = {f"{name} {house}", f"{house}, {name}", f"{name} {house}".upper()}
        forms |= {f"{rng.choice(given[name])} {house}" for _ in range(2)} | {f"{name} {typo(house)}"}
        groups.append(forms)
    for _ in range(firms):
        trade, house = rng.choice(sorted(trades)), word()
        groups.append({f"{house} {trade} GmbH", f"{trade} {house} G.m.b.H.", f"{house} {rng.choice(trades[trade])} Ges. mbH", f"{typo(house)} {trade}"})
    return groups


def test_names_are_learnt(spark):
    """Short forms are told from the names themselves: spellings of invented parties are found again, and no others linked."""
    rng = random.Random(12)
    given = {"Thomas": ["Tom", "Massl"], "Giovanni": ["Gianni", "Vanni"], "Leopold": ["Poldi", "Leo"], "Aurelia": ["Relly", "Aury"], "Sigismund": ["Siggi", "Mundl"], "Beatrix": ["Trixi", "Bea"], "Konstantin": ["Kosta", "Dino"], "Philippa": ["Pippa", "Lippi"], "Ferdinand": ["Nando", "Ferdl"], "Walburga": ["Burgl", "Wally"]}
    trades = {"Software": ["Softw.", "Sw"], "Brewery": ["Brwy", "Brew."], "Printing": ["Prtg", "Print."], "Insurance": ["Ins.", "Insur."], "Carpentry": ["Carp.", "Crptry"], "Laundry": ["Lndry", "Laun."]}
    groups = made_names(rng, 700, 400, given, trades)
    rows = spark.createDataFrame([(x,) for g in groups for x in sorted(g)], "name string")
    got = {(r["name_a"], r["name_b"]) for r in name_pairs(rows, "name").collect()}
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.99 * len(got)
    means = {r["word"]: r["means"] for r in word_meanings(parsed_names(rows, "name")).where("means is not null").collect()}
    assert means["massl"] == ["thomas"] and means["burgl"] == ["walburga"] and means["crptry"] == ["carpentry"] and means["thomas"] == ["thomas"]


def test_numbered_names(spark):
    """A word beside thousands of numbers is common, and numbers aren't misspellings."""
    rows = spark.range(3000).select(F.concat(F.lit("Client "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name")).unionByName(spark.createDataFrame([("CLIENT 000007",)], "name string"))
    assert [tuple(r) for r in name_pairs(rows, "name").collect()] == [("CLIENT 000007", "Client 000007")]
    assert word_meanings(parsed_names(rows, "name")).where("common").select("word").collect()[0]["word"] == "client"


def test_few_names(spark):
    groups = [["Thomas Keller", "Keller, Tom", "KELLER THOMAS", "Thomas Keler"], ["Gertrude Keller"], ["Acme Software Ltd", "Acme Softw. Limited"], ["Zuzelina Kappa"], ["Robert Rossi"], ["Robert Rossini"]]
    rows = spark.createDataFrame([(x, "e", 1) for x in [x for g in groups for x in g] + [None, "-", "unknown", "Thomas Keller", ""]], "counterparty_name string, entity string, n int")
    want = {(min(a, b, key=str.encode), max(a, b, key=str.encode)) for g in groups for a in g for b in g if a != b}
    got = [(r["name_a"], r["name_b"]) for r in name_pairs(rows, "counterparty_name").collect()]
    assert set(got) == want and len(got) == len(want)
    assert name_pairs(rows.limit(0), "counterparty_name").count() == 0
    assert {r["name"]: r["links"] for r in name_entities(rows, "counterparty_name").collect()}["Zuzelina Kappa"] == 0


def test_components(spark):
    rng = random.Random(10)
    edges = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(150)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("n1", None), ("s", "s")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    groups = defaultdict(list)
    for x in parent:
        groups[find(x)].append(x)
    assert got == {x: min(g) for g in groups.values() for x in g}


def test_marginals(spark):
    odds = {(1, 10): 2.0, (1, 11): 1.0, (2, 10): 1.5, (3, 12): -1.0}
    exact, total = dict.fromkeys(odds, 0.0), 0.0
    pairs = list(odds)
    for bits in range(1 << len(pairs)):
        chosen = [p for i, p in enumerate(pairs) if bits >> i & 1]
        if len({b for b, _ in chosen}) == len(chosen) == len({s for _, s in chosen}):
            w = np.exp(sum(odds[p] for p in chosen))
            total += w
            for p in chosen:
                exact[p] += w
    got = propagate(spark.createDataFrame([(b, s, o) for (b, s), o in odds.items()], "b bigint, s bigint, odds double"))
    assert {(r["b"], r["s"]): r["p"] for r in got.collect()} == pytest.approx({p: w / total for p, w in exact.items()}, abs=1e-3)  # the graph is a tree


ENTRY = "entry_id bigint, ref string, currency string, amount decimal(18,2), value_ts timestamp, description string, iban string, counterparty_name string, score int"


def test_entities(spark):
    at = datetime(2024, 5, 1, 12, tzinfo=UTC)
    e = lambda i, a, d, text, iban, name, days=0, cur="EUR": (i, f"r{i}", cur, None if a is None else D(a), at + timedelta(days=d + days), text, iban, name, 1)
    book = [e(1, "100.00", 0, "INV 31000001", "DE001234567890", "Bob Gawufeplawu"), e(2, "100.00", 0, "INV 31000002", None, None), e(3, "55.50", 0, "seed delivery / 31000003", None, "Stiwohazovu Transport BV"), e(4, None, 0, None, None, None), e(5, "9.00", 0, "INV 31000009", None, "Nobody Else")]
    stmt = [e(101, "100.00", 1, "WIRE 31000001 CATERING", None, "GAWUFEPLAWU ROBERT"), e(102, "100.00", 1, "WIRE 31000002 CATERING", "DE00**********", None), e(103, "52.00", 2, "STO 00003 SEED D", None, None), e(104, "52.00", 2, "STO 00003 SEED D", None, None), e(105, "9.00", 90, "WIRE 31000077", None, "Someone Other")]
    stmt[3] = (104, *stmt[2][1:])
    reviewed = spark.createDataFrame([(5, 105, D("1.0000")), (1, 102, D("0.0000"))], "source_id bigint, target_id bigint, score decimal(5,4)")
    got = matched_entries(spark.createDataFrame(book, ENTRY), spark.createDataFrame(stmt, ENTRY), reviewed).where("score >= 0.5")
    assert {(r["book_entry_id"], r["stmt_entry_id"]) for r in got.collect()} == {(1, 101), (2, 102), (3, 103), (3, 104), (5, 105)}
    none = spark.createDataFrame([], ENTRY)
    assert matched_entries(none, none, reviewed.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    """Reviewed pairs that the operator isn't told are found again."""
    t = Tables(spark, "/root/testdata/sf0.01")
    found = matched_entries(t.book_entry, t.stmt_entry, t.matched_pair.limit(0)).where("score >= 0.5").toPandas()
    pairs = set(zip(found["book_entry_id"], found["stmt_entry_id"], strict=True))
    known = t.matched_pair.toPandas()
    right = [(a, b) in pairs for a, b, s in known.itertuples(index=False) if s == 1]
    wrong = [(a, b) in pairs for a, b, s in known.itertuples(index=False) if s == 0]
    assert np.mean(right) >= 0.9 and not any(wrong)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_sql_names_are_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert languages.SAMPLE_DOCS > 0 and pd is not None
