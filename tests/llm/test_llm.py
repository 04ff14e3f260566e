"""Problems 1, 6, 7 and 8: against brute force, exact round trips and hand-made texts."""

import random
import statistics

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebox.llm import fitting, mixing, names, pii, split_overlap, tokens

# ---------------------------------------------------------------- 1: overlaps

ROW = "text string, item string, is_eval boolean, split_name string, session string"


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def edited(rng, s, n):
    for _ in range(n):
        i, c = rng.randrange(len(s) + 1), rng.choice("0123456789abcdef")
        s = rng.choice((s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]))
    return s


def overlap_case(seed, lengths):
    rng = random.Random(seed)
    base = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice(lengths))) for _ in range(25)]
    train = [edited(rng, rng.choice(base), rng.randrange(3)) for _ in range(60)]
    evals = [edited(rng, rng.choice(base), rng.randrange(6)) for _ in range(60)]
    data = [(t, f"t{i}", False, "train", "a") for i, t in enumerate(train)] + [(t, f"v{i}", True, "test", "b") for i, t in enumerate(evals)]
    want = {(f"v{j}", f"t{i}") for i, t in enumerate(train) for j, v in enumerate(evals) if t and v and distance(t, v) <= 3}
    return data, want


@pytest.mark.parametrize("seed, lengths, hot", [(2, (57, 58, 59, 60, 61, 62, 63, 64, 67), 100_000), (3, (20, 23, 24, 26, 30), 3), (4, (1, 2, 3, 5, 9, 10, 11, 12, 13, 14, 15), 3), (5, (200, 64, 12), 100_000)])
def test_overlaps_equal_brute_force(spark, seed, lengths, hot):
    data, want = overlap_case(seed, lengths)
    got = split_overlap.overlaps(spark.createDataFrame(data, ROW), hot_pairs=hot)
    assert {(r.item_e, r.item_t) for r in got.collect()} == want and want


def test_a_common_prefix_is_broken_up_without_loss(spark):
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    train = ["0" * 20 + hexes(44) for _ in range(150)]
    evals = [edited(rng, t, 3) for t in train[:50]] + ["0" * 20 + hexes(44) for _ in range(100)]
    data = [(t, f"t{i}", False, "train", "a") for i, t in enumerate(train)] + [(t, f"v{i}", True, "test", "b") for i, t in enumerate(evals)]
    df = spark.createDataFrame(data, ROW)
    got = {(r.item_e, r.item_t) for r in split_overlap.overlaps(df, hot_pairs=1000).collect()}
    assert got == {(f"v{j}", f"t{i}") for i, t in enumerate(train) for j, v in enumerate(evals) if distance(t, v) <= 3} and len(got) >= 50
    from sluicebox.functions.ids import pack_id

    packed = df.select("is_eval", pack_id(F.col("text")).alias("packed"))
    assert split_overlap.candidates(packed, 1000).count() < 0.1 * split_overlap.candidates(packed, 10**9).count()


def test_overlaps_of_odd_rows(spark):
    a = "a" * 64
    data = [(a, "t", False, "train", "s"), (" A" + "a" * 63, " T", False, "train", "s"), (a, "v", True, "test", "s"), (None, "x", True, "test", "s"), (a, None, True, "test", "s"), ("", "y", True, "test", "s"), (a, "z", None, None, "s")]
    got = split_overlap.overlaps(spark.createDataFrame(data, ROW)).collect()
    assert [(r.item_e, r.item_t, r.distance, r.containment) for r in got] == [("v", "t", 0, 1.0)]
    assert split_overlap.overlaps(spark.createDataFrame([], ROW)).isEmpty()
    with pytest.raises(ValueError):
        split_overlap.overlaps(spark.createDataFrame([], ROW), edits=4)


def gram_share(a, b):
    q = max(2, next((q for least, q in split_overlap.GRAMS if len(a) >= least), 0))
    cut = lambda x: {x[i : i + q] for i in range(len(x) - q + 1)} or {x}
    return len(cut(a) & cut(b)) / len(cut(a))


@pytest.mark.parametrize("hot", [40, 100_000])
def test_containment_is_that_of_the_sets_of_grams_however_hot(spark, hot):
    data, want = overlap_case(7, (3, 8, 13, 30, 64))
    text = {r[1]: r[0] for r in data}
    got = split_overlap.overlaps(spark.createDataFrame(data, ROW), hot_pairs=hot).collect()
    assert {(r.item_e, r.item_t) for r in got} == want
    for r in got:
        assert r.containment == pytest.approx(gram_share(text[r.item_e], text[r.item_t])) and r.distance == distance(text[r.item_e], text[r.item_t])


def test_hot_keys_within_hot_keys(spark):
    """Prefixes longer than one gram: the finer keys are hot again."""
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    train = ["0" * 40 + hexes(30) for _ in range(60)]
    evals = [edited(rng, t, 3) for t in train[:30]] + ["0" * 40 + hexes(30) for _ in range(30)]
    data = [(t, f"t{i}", False, "train", "a") for i, t in enumerate(train)] + [(t, f"v{i}", True, "test", "b") for i, t in enumerate(evals)]
    got = {(r.item_e, r.item_t) for r in split_overlap.overlaps(spark.createDataFrame(data, ROW), hot_pairs=100).collect()}
    assert got == {(f"v{j}", f"t{i}") for i, t in enumerate(train) for j, v in enumerate(evals) if distance(t, v) <= 3} and len(got) >= 30


def test_texts_of_many_records_go_by_parts(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "PART_RECORDS", 3)
    a, b = "a" * 64, "a" * 62 + "bc"
    data = [(a, f"t{i}", False, "train", "s") for i in range(10)] + [(b, f"v{i}", True, "test", "s") for i in range(7)] + [(b, "v0", True, "test", "s"), (a, "v0", True, "test", "s")]
    df = spark.createDataFrame(data, ROW)
    got = [(r.item_e, r.item_t, r.distance) for r in split_overlap.overlaps(df).collect()]
    assert sorted(got) == sorted((f"v{j}", f"t{i}", 2 if j else 0) for j in range(7) for i in range(10))
    pairs = sorted((r.text_e, r.text_t, r.n_e, r.n_t, r.distance) for r in split_overlap.text_overlaps(df).collect())
    assert pairs == sorted([(a, a, 1, 10, 0), (b, a, 7, 10, 2)])


# ---------------------------------------------------------------- 6: tokens

TEXTS = ["", None, " ", "\n\n  \t x", "don't, we'll 've 'S", "Gebühren  für 12345 sats!!", "セッションは97。", "<|endoftext|> and <|startoftext|>", "a" * 5000, "word " * 3000, "  x　y​", "👩‍👩‍👧 ok", "\U0001e900 ౝ Ᲊ \U00010d40", "x\r\n\r\ny   ", "½ ² Ⅷ ٣"]


def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


def test_ids_are_those_of_the_tokenizer(spark):
    want = reference()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("pos", F.lit(1))
    for common in (0, 5, 20_000):
        got = {r.doc_id: list(r.ids) for r in tokens.encode(df, common=common).collect()}
        assert got == {i: want(t) for i, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert sizes == {i: len(want(t)) for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_ids_of_whole_test_data(spark, sf):
    want = reference()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(docs).collect()}
    assert got == {r.doc_id: want(r.text) for r in docs.select("doc_id", "text").collect()}


def test_the_wide_form_gives_the_same(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    assert rows(tokens.encode(df, wide=True)) == rows(tokens.encode(df, wide=False))


def test_a_frequent_word_too_large_is_passed_over(spark):
    table = spark.createDataFrame([("x" * 500, 9, [1]), ("a", 5, [2]), ("b", 4, [3])], "word string, n bigint, ids array<int>")
    assert rows(tokens._common(table, 10, 300).select("word")) == [("a",), ("b",)]
    assert rows(tokens._common(table, 2, 300).select("word")) == [("a",)]
    assert rows(tokens._common(table, 10, 100).select("word")) == [("a",)]


def test_repeated_rows_and_empty_tables(spark):
    want = reference()
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (2, ""), (2, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in tokens.encode(df).collect())
    assert got == sorted([(1, want("a b")), (1, want("c")), (0, want("d")), (2, [])])
    assert tokens.count_tokens(df).where("doc_id = 1").agg(F.sum("n_tokens")).first()[0] == len(want("a b")) + len(want("c"))
    assert tokens.encode(df.limit(0)).isEmpty()


# ---------------------------------------------------------------- 7: mixing

DOC, TARGET = "doc_id bigint, source string, n_tokens bigint", "source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, **kw):
    d, t = spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET)
    m = mixing.mix(d, t, **kw)
    return {r.doc_id: r.copies for r in m.collect()}, {r.source: r for r in mixing.report(d, t, m).collect()}


def test_shares_come_out(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice((" Big", "big ", "big", "small")) if i % 10 else "small", rng.randrange(1, 400) if i % 50 else 5000) for i in range(3000)]
    targets = [("BIG", 0.6, 2), ("small", 0.3, 3), ("missing", 0.1, 5)]
    for block in (100, 4096):
        copies, report = mixed(spark, docs, targets, block=block)
        for s in ("big", "small"):
            r = report[s]
            assert abs(r.tokens_used - r.tokens_wanted) < (10 if block > 3000 else 10_001) or r.is_capped
            used = [c for i, c in copies.items() if mixing_name(docs[i][1]) == s]
            assert max(used) <= r.max_repeats and sum(used) == r.documents_used
        assert report["missing"].tokens_used == 0


def mixing_name(s):
    return s.strip().lower()


def test_caps_hold_and_are_reported(spark):
    copies, report = mixed(spark, [(i, "a", 10) for i in range(10)] + [(100 + i, "b", 10) for i in range(90)], [("a", 0.9, 2), ("b", 0.1, 1)])
    assert report["a"].is_capped and report["a"].tokens_used == 200 and all(copies[i] == 2 for i in range(10))
    assert report["b"].tokens_used == 100 and report["b"].share_reached == pytest.approx(1 / 3)


def test_room_is_filled_up_to_the_total(spark):
    docs = [(i, "a", 10) for i in range(10)] + [(100 + i, "b", 10) for i in range(60)] + [(300 + i, "c", 10) for i in range(30)]
    d, t = spark.createDataFrame(docs, DOC), spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 1), ("none", 0.1, 9)], TARGET)
    m = mixing.mix(d, t, fill=True)
    used = {r.source: r.tokens_used for r in mixing.report(d, t, m).collect()}
    assert used["a"] == 200 and used["none"] == 0 and sum(used.values()) == pytest.approx(1000, abs=20) and used["b"] == pytest.approx(3 * used["c"], abs=30)
    assert mixing.level([0.5, 0.5], [10.0, 10.0], 30.0) == float("inf") and mixing.level([0.5, 0.5], [10.0, 100.0], 30.0) == pytest.approx(40.0)
    assert mixing.mix(d.limit(0), t, fill=True).isEmpty() and mixing.mix(d, t.limit(0), fill=True).isEmpty()


def test_mixing_odd_input(spark):
    copies, report = mixed(spark, [(1, None, 5), (2, "x", 0), (3, "x", None), (4, "y", 7)], [("x", 1.0, 1), (None, 0.5, 1), ("y", None, 3), ("z", -1.0, 1)])
    assert copies == {} and report["x"].tokens_used == 0 and set(report) == {"x", "y", "z"}
    assert mixed(spark, [], [("x", 1.0, 1)])[0] == {}
    assert mixed(spark, [(1, "x", 5)], [])[0] == {}


def test_the_flight_keeps_totals_and_probabilities():
    import numpy as np

    rng = random.Random(4)
    size = [float(rng.randrange(1, 100)) for _ in range(60)]
    p = [rng.random() for _ in size]
    total = np.zeros(60)
    for k in range(400):
        out = mixing.fly(p, size, np.random.default_rng(k))
        assert sum(0 < x < 1 for x in out) <= 2
        assert sum(out) == pytest.approx(sum(p), abs=1e-6) and sum(a * b for a, b in zip(out, size, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, size, strict=True)), abs=1e-4)
        total += out
    assert statistics.mean(abs(total / 400 - p)) < 0.03
    assert all(x in (0.0, 1.0) for x in mixing.land(out, size))


# ---------------------------------------------------------------- 8: personal information

SPANS = [
    ("Please call +1 (415) 555-0123 ext. 7 and ask for Tiro von Vespamura before noon.", [("phone", "+1 (415) 555-0123 ext. 7"), ("name", "Tiro von Vespamura")]),
    ("Write to ann.bee+x@mail.example.test, or to cee_d (at) feed (dot) example.", [("email", "ann.bee+x@mail.example.test"), ("email", "cee_d (at) feed (dot) example")]),
    ("Write \"at feed dot com\" in a label. Escalated to bo at mail dot test.", [("email", "bo at mail dot test")]),
    ('{"who":"Bo Okuba","mail":"bo.d AT mail DOT test","tx":"1"}', [("name", "Bo Okuba"), ("email", "bo.d AT mail DOT test")]),
    ("see p0@270072354. The root@ field and @here are no addresses; raw@1:123.", []),
    ("Totals went to +1 026 284, then 01.99.58, then 977-799 sat at 2026-03-01.", []),
    ("Open batch 666-73-1065 and job 0067815572, QT-3627-4706.", []),
    ("Somebody pasted a social security number (666533792) into #12; id: 00 571 822 241.", [("id_number", "666533792"), ("id_number", "00 571 822 241")]),
    ("Signed: O'Dunka, Mira, 12B Ember Lane, Apt 3B, Norhaven 06222, tel. 030/23125-505", [("name", "O'Dunka, Mira"), ("address", "12B Ember Lane, Apt 3B, Norhaven 06222"), ("phone", "030/23125-505")]),
    ("Anschrift: Birkenauer Straße 12 b, 12345 Brunstadt, Tel. 0044 20 7946 0762", [("address", "Birkenauer Straße 12 b, 12345 Brunstadt"), ("phone", "0044 20 7946 0762")]),
    ("Domicile : 70 bis bd Saint-Orbin, 05598 Saint-Orbin ; tél. 01.99.00.93.86", [("address", "70 bis bd Saint-Orbin, 05598 Saint-Orbin"), ("phone", "01.99.00.93.86")]),
    ("Domicilio: C/ Molino Viejo 33, 2.º B, 49804 Villanoria, tel. +34 999 00 14 64", [("address", "C/ Molino Viejo 33, 2.º B, 49804 Villanoria"), ("phone", "+34 999 00 14 64")]),
    ("May brought less traffic. Grace of a slow hour; the Will-Call queue and Grant Harbor replica said the same. Kafka, Grafana and Athena agree.", []),
    ("11 Main tables, 41 Park threads, 16 Lane listings; lane 24 of the road map.", []),
    ("Dr. May Okubadal asked why. The new badge for Ostiholt, Iris was issued against ID QQ 12 70 01 C.", [("name", "May Okubadal"), ("name", "Ostiholt, Iris"), ("id_number", "QQ 12 70 01 C")]),
    ("présentée à l'accueil par Büno Lindumoor.", [("name", "Büno Lindumoor")]),
    ("👩‍👩‍👧 thx Ragna, will look. --\n", [("name", "Ragna")]),
]


@pytest.mark.parametrize("text, want", SPANS)
def test_spans(text, want):
    got = pii.Finder().spans(text)
    assert [(k, text[a:b]) for a, b, k in got] == want


def test_an_address_may_end_with_its_code():
    for text in ("Am Alten Speicher 5, 12345.", "Parcel to Am Alten Speicher 5,\n12345"):
        assert [(k, text[a:b]) for a, b, k in pii.Finder().spans(text)] == [("address", text[text.index("Am") :].rstrip("."))]


def test_replacement_leaves_the_rest_and_links_equal_values(spark):
    data = [(i, t) for i, (t, _) in enumerate(SPANS)] + [(98, None), (99, ""), (100, SPANS[0][0])]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("spans_", F.lit("clash")).withColumn("s", F.lit(1))
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert out[98].text_out is None and out[99].text_out == "" and out[98].spans == []
    assert out[0].text_out == out[100].text_out and out[0].s == 1
    for i, (t, want) in enumerate(SPANS):
        rest, at = out[i].text_out, 0
        for s in out[i].spans:
            assert rest.startswith(t[at : s.start_char])
            rest = rest[s.start_char - at :]
            assert rest.startswith(f"[{s.kind.upper()}:")
            rest, at = rest[rest.index("]") + 1 :], s.end_char
        assert rest == t[at:]
    flat = rows(pii.found(df).where("doc_id = 0").select("kind", "start_char", "end_char"))
    assert flat == [("name", 49, 67), ("phone", 12, 36)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=20), st.binary(min_size=1, max_size=8))
def test_feistel_is_invertible(value, key):
    moved = pii.feistel(value, 10, key, "phone")
    assert len(moved) == len(value) and all(0 <= x < 10 for x in moved)
    assert pii.unfeistel(moved, 10, key, "phone") == value


def test_feistel_is_one_to_one_and_keeps_the_format():
    seen = {tuple(pii.feistel([a, b, c], 10, b"k")) for a in range(10) for b in range(10) for c in range(10)}
    assert len(seen) == 1000
    number = "+44 (0)113 496 0775"
    moved = pii.permuted(number, b"k", "phone")
    assert moved != number and [c if not c.isdigit() else "9" for c in moved] == [c if not c.isdigit() else "9" for c in number]
    assert pii.permuted(moved, b"k", "phone", back=True) == number and pii.permuted(number, b"l", "phone") != moved
    assert pii.permuted(pii.permuted("QQ 12 70 01 C", b"k", "id_number"), b"k", "id_number", back=True) == "QQ 12 70 01 C"


def test_numbers_in_other_digits_are_moved_and_linked():
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in s)
    arabic = lambda s: "".join(chr(0x660 + int(c)) if c.isdigit() else c for c in s)
    for kind, number in (("phone", "0113 496 0775"), ("id_number", "QQ 12 70 01 C")):
        moved = pii.permuted(number, b"k", kind)
        assert moved != number
        for form in (wide, arabic):
            assert pii.permuted(form(number), b"k", kind) == form(moved)
            assert pii.permuted(form(moved), b"k", kind, back=True) == form(number)
            assert form(number) not in pii.placeholder(kind, form(number), b"k")


def test_recall_and_precision_on_sentences_held_out():
    """No sentence of these stands among those the operator is fitted on, and no corpus has taught it anything."""
    from collections import Counter

    from held_out import cases

    finder, both, ours, true = pii.Finder(), Counter(), Counter(), Counter()
    for text, want in cases():
        got = {(k, a, b) for a, b, k in finder.spans(text)}
        for bag, spans in ((both, got & set(want)), (ours, got), (true, want)):
            bag.update(k for k, *_ in spans)
    figures = {k: (round(both[k] / true[k], 2), round(both[k] / max(1, ours[k]), 2)) for k in pii.KINDS}
    assert all(r >= 0.9 and p >= 0.9 for r, p in figures.values()), figures


def test_numbers_are_linked_however_they_are_written():
    move = lambda x: pii.permuted(x, b"k", "phone")
    digits = lambda x: "".join(c for c in x if c.isdigit())
    forms = ["+1 202-555-0143", "(202) 555-0143", "1-202-555-0143", "202.555.0143 ext. 7"]
    moved = [move(f) for f in forms]
    assert len({digits(m.split("ext")[0])[-10:] for m in moved}) == 1 and moved[0].startswith("+1 ") and moved[3].endswith("ext. 7")
    assert moved[1][1] in "23456789" and digits(moved[1])[3] in "23456789"
    german = [move(f) for f in ("+49 (0)30 23125-725", "030/23125-725", "0049 30 23125 725")]
    assert len({digits(m)[-10:] for m in german}) == 1 and german[0].startswith("+49 (0)") and german[2].startswith("0049 ")
    for f in forms:
        assert pii.permuted(move(f), b"k", "phone", back=True) == f


def test_valid_numbers_stay_valid():
    for number in range(12345600, 12345680):
        valid = f"{number}{pii._DNI[number % 23]}"
        moved = pii.permuted(valid, b"k", "id_number")
        assert moved[-1] == pii._DNI[int(moved[:8]) % 23] and pii.permuted(moved, b"k", "id_number", back=True) == valid
    assert len({pii.permuted(f"{n:08}{pii._DNI[n % 23]}", b"k", "id_number") for n in range(3000)}) == 3000
    wrong = pii.permuted("12345678A", b"k", "id_number")
    assert pii.permuted(wrong, b"k", "id_number", back=True) == "12345678A"
    tax = pii.permuted("86095742719", b"k", "id_number")
    assert pii._tax_check([*map(int, tax[:10])]) == int(tax[10]) and pii.permuted(tax, b"k", "id_number", back=True) == "86095742719"
    social = pii.permuted("1 84 12 76 451 089 46", b"k", "id_number")
    n = int(social.replace(" ", ""))
    assert n % 100 == 97 - n // 100 % 97 and pii.permuted(social, b"k", "id_number", back=True) == "1 84 12 76 451 089 46"
    for kept in ("123-45-6789", "AB 12 34 56 C", "X1234567L", "L01X00T47", "7", "A1", "666-00-0000"):
        moved = pii.permuted(kept, b"k", "id_number")
        assert pii.permuted(moved, b"k", "id_number", back=True) == kept
    assert pii.permuted("123-45-6789", b"k", "id_number")[:3] not in ("000", "666") and pii.permuted("AB 12 34 56 C", b"k", "id_number")[-1] in "ABCD"


def test_dates_of_birth_are_moved_where_asked_for():
    text = "Born on 29.02.2000, seen on 01.03.2026; dob: 1987-11-30, geb. am 31.02.1999."
    assert pii.Finder().spans(text) == []
    got = [text[a:b] for a, b, k in pii.Finder(dates=True).spans(text) if k == "date"]
    assert got == ["29.02.2000", "1987-11-30"]
    for d in got:
        moved = pii.moved_date(d, b"k")
        assert moved != d and len(moved) == len(d) and pii.moved_date(moved, b"k", back=True) == d


def test_replacements_turn_back(spark):
    data = [(i, t) for i, (t, _) in enumerate(SPANS)] + [(98, None), (99, ""), (100, SPANS[0][0])]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    out = pii.pseudonymise(df, "k")
    assert rows(pii.restored(out, "k")) == rows(df)
    known = {r.tag: (r.kind, r.value) for r in pii.tags(out, "k").collect()}
    assert all(len(t) == 32 for t in known) and ("name", "Tiro von Vespamura") in known.values()
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")


def test_a_model_of_a_corpus(spark):
    """What stands in signatures is known elsewhere; the fit doesn't depend on the order of rows, and nothing is needed."""
    made = [f"All fine.\n\nRegards,\n{g} Qhelvadour" for g in ("Thrigwen", "Ozmelia", "Parvendo")] * 3 + ["thrigwen qhelvadour left. the cart is late. Nobody came.", "the cart is late", "the cart is late"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "doc_id bigint, text string")
    model = pii.fit(df)
    assert {"qhelvadour"} <= set(model.parts) and pii.fit(df.orderBy(F.desc("doc_id"))) == model
    text = "Then Ozmelia Qhelvadour left."
    assert [text[a:b] for a, b, _ in pii.Finder(model).spans(text)] == ["Ozmelia Qhelvadour"]
    assert pii.fit(df.limit(0)).parts == {}
    assert rows(pii.found(df.limit(0), model=model)) == []


def test_a_model_counts_every_text(spark):
    """Of more texts than 6,000, of long ones and of many towns none is left out."""
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04}")
    rare = [f"Zorv{word(i)}" for i in range(40)]
    towns = [f"Brun{word(i)}" for i in range(2100)]
    made = [f"run {i} is late, nothing else was seen." for i in range(7000)]
    made += [f"Nr. {k} is fine.\n\nRegards,\n{w}" for w in rare for k in (1, 2)]
    made += ["the queue is slow. " * 1200 + f"Nr. {k} is fine.\n\nRegards,\nQhelvadour" for k in (1, 2)]
    made += [f"{k}: " + "; ".join(f"12 Ember Lane, {t} 06222" for t in towns[i : i + 100]) for i in range(0, 2100, 100) for k in (1, 2)]
    model = pii.fit(spark.createDataFrame([(x,) for x in made], "text string"))
    assert {w.lower() for w in rare} | {"qhelvadour"} <= set(model.parts)
    assert set(model.towns) == {t.lower() for t in towns}
    for text in ("12 Ember Lane, Bad Brunau 06222.", "12 Ember Lane,\n> Bad Brunau, AB1 2CD", "Am Alten Speicher 5,\n> 12345 Bad Brunau", "Birkenauer Straße 12, 12345 Bad Brunau."):
        assert set(pii._towns()(text)) == {"bad brunau"} and pii._towns()(text.replace("12345", "1234").replace("06222", "0622").replace("2CD", "2C")) == []


def test_a_word_is_as_common_in_a_corpus_of_any_size():
    counts = [("often", 0, 50, 60, 0, 0), ("capital", 0, 900, 0, 0, 0), ("seldom", 0, 0, 9, 0, 0), ("stray", 3, 900, 0, 0, 0), ("name", 3, 9, 0, 1, 2)]
    small = names.lexicon([(w, *(x // 10 for x in xs)) for w, *xs in counts], 6000)
    large = names.lexicon(counts, 60_000)
    assert small.common == {"often", "capital", "stray"} and large.common == small.common and large.plain == small.plain
    assert large.parts == {"name": (1, 2)}


def test_gradients_of_tasks_give_the_model_of_the_driver(spark):
    lex = names.lexicon([("ozmelia", 3, 0, 0, 3, 0), ("cart", 0, 2, 9, 0, 0)], 10)
    df = spark.createDataFrame([(f"Then Ozmelia left the Cart {x}.",) for x in "abcdefgh"], "t string")
    different = fitting.examples(df, str, lex)
    here, apart = (fitting.regression(different, lex, n) for n in (1 << 26, -1))
    assert here.weights.keys() == apart.weights.keys() and all(abs(here.weights[f] - w) <= 0.002 for f, w in apart.weights.items())
    assert here.weights != names.base_model().weights


def test_very_long_texts(spark):
    text = "x1 " * 30_000 + "mail a@b.example now. " + "A" * 50_000
    assert [k for *_, k in pii.Finder().spans(text)] == ["email"]
