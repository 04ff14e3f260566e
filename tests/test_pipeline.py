"""Messages to events, features, rules and gate; batch and stream; serving, splits, evaluation, models."""

import json
import random
from datetime import datetime, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sluicebox.contracts import CAPTURE_SESSIONS, LIFECYCLE_EVENTS, TRANSACTIONS
from sluicebox.operators import dataset, enrichment, evaluate, features, first_wins, forest, gate, normalise, registry, rules, serving, sweep
from sluicebox.session import scratch

A, B = "a" * 64, "B" * 64
TX = {"txid": A, "vin": [{"sequence": 0xFFFFFFFF}, {"sequence": 1}], "vout": [{"value": 100_000}, {"value": 5}, {"value": 100_000}, {"value": 0}], "weight": 561, "fee": 1601}
MESSAGE = "schema_version int, run_id string, session_id string, message_id string, received_at string, source_mode string, message_type string, raw_text string"


def message(payload, **changes):
    m = {"schema_version": 1, "run_id": "run", "session_id": "con", "message_id": "m:1", "received_at": "2026-03-01T01:02:03Z", "source_mode": "ws", "message_type": "text", "raw_text": payload if payload is None or isinstance(payload, str) else json.dumps(payload)}
    return tuple((m | changes).values())


def messages(spark, *ms):
    return spark.createDataFrame(list(ms), MESSAGE)


# ---------------------------------------------------------------- normalise


def test_events_of_all_shapes(spark):
    body = {"mempool-txids": {"sequence": 7, "added": [A, {"txid": B}, 5], "replaced": [{"replaced": A, "by": {"txid": B}}, {"replaced": A}]}, "mempool-transactions": {"removed": []}}
    got = normalise.events(messages(spark, message(body))).orderBy("event_type", "pos").collect()
    assert [(r.event_type, r.txid, r.replacement_txid, r.source_sequence) for r in got] == [("added", A, None, 7), ("added", B.lower(), None, 7), ("added", None, None, 7), ("replaced", A, B.lower(), 7), ("replaced", A, None, 7)]
    import hashlib

    want = hashlib.sha256(json.dumps(["m:1", "mempool-txids", "added", 0], separators=(",", ":")).encode()).hexdigest()
    assert got[0].event_id == want and got[0].event_time == datetime(2026, 3, 1, 1, 2, 3)


@pytest.mark.parametrize(
    "changes, detail",
    [
        ({"schema_version": 2}, "envelope version is not supported"),
        ({"run_id": ""}, "no run_id in the envelope"),
        ({"received_at": "2026-03-01T01:02:03"}, "received_at is no ISO time with a zone"),
        ({"message_type": "binary"}, "binary message"),
        ({"raw_text": '{"a": NaN}'}, "raw_text is no valid JSON"),
        ({"raw_text": None}, "raw_text is no valid JSON"),
        ({"raw_text": "[1]"}, "raw_text is no JSON object"),
    ],
)
def test_envelope_issues(spark, changes, detail):
    m = messages(spark, message({"mempool-txids": {"added": [A]}}, **changes))
    assert [r.detail for r in normalise.issues(m, ["message_id"]).collect()] == [detail]
    assert normalise.events(m).isEmpty()


def test_channel_issues(spark):
    m = messages(spark, message({"mempool-txids": {"sequence": True, "added": {"txid": A}, "mined": ["x"]}, "mempool-transactions": 3}))
    got = {r.detail for r in normalise.issues(m, ["message_id"]).collect()}
    assert got == {"mempool-txids.sequence is no whole number", "mempool-txids.added is no list", "mempool-txids.mined[0] has no usable txid", "mempool-transactions is no object"}
    assert [r.is_recognised for r in normalise.recognised(messages(spark, message({"x": 1}), message({"mempool-txids": {}}))).collect()] == [False, True]


# ---------------------------------------------------------------- features and rules


def extracted(spark, *txs):
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(txs)], "i int, t string").select("i", F.parse_json("t").alias("entry"))
    return [(r.features.asDict() if r.features else None, r.reason) for r in features.extract(df).orderBy("i").collect()]


def test_features(spark):
    got = extracted(spark, TX)[0][0]
    assert got == {"n_in": 2, "n_out": 4, "value_out_sat": 200_005, "fee_sat": 1601, "vsize": 141, "fee_rate_sat_vb": round(1601 / 141, 6), "max_equal_output_count": 2, "round_amount_fraction": round(2 / 3, 6), "rbf_signaled": True}


@pytest.mark.parametrize(
    "change",
    [{"vin": []}, {"vout": [3]}, {"weight": 3.0}, {"weight": True}, {"weight": 0}, {"fee": -1}, {"fee": "1"}, {"vout": [{"value": None}]}, {"vin": [{"is_coinbase": True}]}, {"vin": {}}],
)
def test_unusable_transactions_are_rejected_with_a_reason(spark, change):
    made, reason = extracted(spark, TX | change)[0]
    assert made is None and reason


def test_replaceability_has_three_values(spark):
    seq = lambda *s: TX | {"vin": [{"sequence": x} if x != "none" else {} for x in s]}
    got = [f["rbf_signaled"] for f, _ in extracted(spark, seq(0xFFFFFFFF, 0xFFFFFFFE), seq(0xFFFFFFFF, "none"), seq("none", 5), seq(0xFFFFFFFF, 2**33))]
    assert got == [False, None, True, None]


def test_an_odd_entry_doesnt_spoil_its_neighbours(spark):
    got = extracted(spark, "text", TX, None, 7)
    assert [r is None for _, r in got] == [False, True, False, False]


def test_rules_and_lab(spark):
    assert all(r.passed for r in rules.lab(spark).collect())
    assert rules.threshold_sweep(spark).count() == 48
    df = spark.createDataFrame([(2, 12, 3, 1, 1, 1, 1.0, 0.5, None), (0, 1, 1, 1, 1, 1, 1.0, 0.5, None), (1, 1, 1, 1, 1, 1, float("nan"), 0.5, True)], "n_in int, n_out int, max_equal_output_count int, value_out_sat bigint, fee_sat bigint, vsize int, fee_rate_sat_vb double, round_amount_fraction double, rbf_signaled boolean")
    got = rules.screen(df).collect()
    assert [(r.rule_ids, r.is_flagged, r.error is None) for r in got] == [(["many_outputs"], True, True), (None, None, False), (None, None, False)]
    assert "12" in got[0].signals[0].explanation
    with pytest.raises(ValueError):
        rules.Thresholds(many_outputs_min=0)


# ---------------------------------------------------------------- gate

ROW = {"txid": A, "event_id": "e", "session": "s", "received_at": "2026-03-01T01:02:03.123456Z", "source_mode": "ws", "feature_set_version": "v", "n_in": 1, "n_out": 1, "value_out_sat": 1, "fee_sat": 1, "vsize": 1, "fee_rate_sat_vb": 1, "max_equal_output_count": 1, "round_amount_fraction": 0.0, "rbf_signaled": None, "ruleset_version": "r", "is_flagged": False, "signal_count": 0, "rule_ids": []}


def gated(spark, *changes):
    data = [(i, json.dumps(ROW | {"txid": f"{i:064x}"} | c)) for i, c in enumerate(changes)]
    return spark.createDataFrame(data, "ord int, body string").select("ord", F.parse_json("body").alias("row"))


def test_gate_reasons(spark):
    cases = [{}, {"n_in": 3.0}, {"n_in": 2**31}, {"n_in": True}, {"fee_sat": 2**63}, {"received_at": "2026-03-01T01:02:03"}, {"rule_ids": [1]}, {"txid": "X" * 64}, {"fee_sat": -1}, {"signal_count": 1}, {"rbf_signaled": "no"}, {"session": None}, {"txid": f"{0:064x}"}, {"txid": f"{8:064x}"}]
    good, bad, failed = gate.validate(gated(spark, *cases), TRANSACTIONS)
    assert rows(good.select("txid")) == [(f"{0:064x}",), (f"{8:064x}",)]  # a rejected row doesn't hold its key
    assert good.first().received_at == datetime(2026, 3, 1, 1, 2, 3, 123000)
    got = {r["check"]: r.n for r in failed.collect()}
    assert got == {"type:n_in": 3, "type:fee_sat": 1, "type:received_at": 1, "type:rule_ids": 1, "check:txid_format": 1, "check:amounts_nonnegative": 1, "check:flag_matches_signals": 1, "type:rbf_signaled": 1, "type:session": 1, "duplicate_key": 1}
    assert bad.count() == 12


def test_gate_of_the_other_tables(spark):
    e = {"event_id": "e", "session": "s", "run_id": "r", "txid": A, "event_type": "seen", "event_time": "2026-03-01T00:00:00Z", "source_sequence": None, "replacement_txid": "x", "source_message_id": "m"}
    df = spark.createDataFrame([(1, json.dumps(e)), (2, json.dumps(e | {"txid": None}))], "ord int, body string").select("ord", F.parse_json("body").alias("row"))
    assert {r["check"] for r in gate.validate(df, LIFECYCLE_EVENTS)[2].collect()} == {"check:event_type_known", "check:replacement_txid_format", "type:txid"}
    assert "PARTITIONED BY (dt string)" in CAPTURE_SESSIONS.ddl("s3a://x")


def test_writing_a_unit_again_replaces_it(spark):
    lake = scratch(spark, "lake")
    gate.write_lake(spark, gated(spark, {}, {"fee_sat": -1}), TRANSACTIONS, lake, "one")
    gate.write_lake(spark, gated(spark, {"txid": B.lower()}), TRANSACTIONS, lake, "two")
    report = gate.write_lake(spark, gated(spark, {}, {}), TRANSACTIONS, lake, "one")
    assert report["rows_written"] == 2 and report["failed_checks"] == {}
    got = gate.read_lake(spark, lake, TRANSACTIONS)
    assert rows(got.select("unit", "dt", "hour")) == [("one", "2026-03-01", 1)] * 2 + [("two", "2026-03-01", 1)]
    from sluicebox.session import hadoop_path

    fs, p = hadoop_path(spark, f"{lake}/_quarantine/transactions/unit=one")
    assert not fs.exists(p)


# ---------------------------------------------------------------- first wins


def test_first_wins(spark):
    df = spark.createDataFrame([("k", 2, "x"), ("k", 1, "x"), ("k", 3, "y"), (None, 1, "z"), ("l", 1, None), ("l", 1, None)], "k string, o int, c string")
    got = sorted((r.k or "", r.o, r.verdict) for r in first_wins.classified(df, ["k"], ["o"], F.xxhash64("c")).collect())
    assert got[:4] == [("", 1, "unkeyed"), ("k", 1, "kept"), ("k", 2, "duplicate"), ("k", 3, "conflict")]
    s = first_wins.summary(df, ["k"], ["o"], F.xxhash64("c")).first()
    assert (s.n_kept, s.n_duplicate, s.n_conflict) == (2, 2, 1)
    assert rows(first_wins.kept(df, ["k"], ["o"])) == [("k", 1, "x"), ("l", 1, None)]
    h = spark.createDataFrame([('{"a":1,"b":2}',), ('{"b": 2, "a": 1}',), ("no json",)], "b string").select(first_wins.canonical_json_hash(F.col("b")).alias("h")).collect()
    assert h[0] == h[1] != h[2]


# ---------------------------------------------------------------- stream and batch


def corpus():
    rng = random.Random(3)
    out = []
    for i in range(12):
        adds = [TX | {"txid": f"{rng.randrange(8):064x}", "fee": rng.randrange(1, 9)} for _ in range(3)]
        out.append(message({"mempool-transactions": {"sequence": i, "added": adds, "removed": [f"{i:064x}", "odd"]}}, message_id=f"m:{i % 10}", received_at=f"2026-03-01T0{i % 3}:00:00Z"))
    return out


def test_stream_gives_what_batch_gives(spark):
    from sluicebox.sources.captures import message_stream
    from sluicebox.streaming import lake as stream

    base, data = scratch(spark, "stream"), corpus()[:10]
    reports = []
    for n, part in enumerate((data[:6], data[4:] + data[:1])):  # the second run brings some again
        messages(spark, *part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = stream.stream_to_lake(message_stream(spark, "file", path=f"{base}/in"), f"{base}/lake", f"{base}/check", on_batch=lambda i, r: reports.append(r))
        q.awaitTermination()
    stream.write_unit(spark, messages(spark, *data), f"{base}/batch", "all")
    for contract in (TRANSACTIONS, LIFECYCLE_EVENTS):
        a, b = (gate.read_lake(spark, f"{base}/{x}", contract).drop("unit") for x in ("lake", "batch"))
        keys = ["txid"] if contract is TRANSACTIONS else a.columns
        assert rows(a.select(*keys)) == rows(b.select(*keys)) and a.count() > 0
    assert sum(r[1]["rows_quarantined"] for r in reports) == 10  # entries without a txid
    assert stream.progress_rows(q)[-1]["rows"] == 7


def test_alert_rules(spark):
    from sluicebox.streaming.lake import alerts

    data = [(datetime(2026, 3, 1, 0, m, tzinfo=timezone.utc), m not in (3, 4, 5), 2000 if m > 6 else 0, 0.0, int(m >= 8)) for m in range(10)]
    got = alerts(spark.createDataFrame(data, "at timestamp, up boolean, lag bigint, age_seconds double, quarantined bigint"))
    assert [(r.at.minute, r.alert) for r in got.orderBy("at", "alert").collect()] == [(5, "down"), (8, "quarantine"), (9, "lag"), (9, "quarantine")]


# ---------------------------------------------------------------- serving


def test_versions_swap_as_a_whole(spark):
    v = serving.Versions(spark, scratch(spark, "serving"))
    assert v.current() is None
    with pytest.raises(FileNotFoundError):
        v.read("t")
    assert v.swap_in({"t": spark.range(3)}) == 0
    with pytest.raises(Exception):
        v.swap_in({"t": spark.range(9), "u": spark.range(1).select(F.raise_error(F.lit("lost")))})
    assert v.read("t").count() == 3 and v.tables() == ["t"]
    assert v.swap_in({"t": spark.range(5)}) == 1 and v.read("t").count() == 5


def test_alert_pages_cover_all_rows_once(spark):
    t = datetime(2026, 3, 1)
    df = spark.createDataFrame([(f"e{i:02}", t.replace(minute=i // 3), i % 2 == 0, "r") for i in range(40)], "event_id string, received_at timestamp, is_flagged boolean, ruleset_version string")
    seen, cursor = [], None
    while True:
        page = serving.alerts_page(df, 7, cursor)
        seen += [a["event_id"] for a in page["alerts"]]
        if not (cursor := page["next_cursor"]):
            break
    assert seen == [f"e{i:02}" for i in range(38, -1, -2)]
    for wrong in (0, 201):
        with pytest.raises(ValueError):
            serving.alerts(df, wrong)
    with pytest.raises(ValueError):
        serving.decode_cursor("no cursor")


# ---------------------------------------------------------------- splits and evaluation


def test_cuts():
    assert dataset.choose_cuts([10, 10, 10, 10, 10]) == (3, 4)
    assert dataset.choose_cuts([1, 1, 1]) == (1, 2)
    with pytest.raises(ValueError):
        dataset.choose_cuts([1, 2])


def test_manifest_notices_changes(spark, sf):
    t = spark.read.parquet(f"{sf}/transactions.parquet")
    m = dataset.manifest(t)
    assert dataset.verify(m, t) == [] and {s["split"] for s in m["sessions"]} == set(dataset.SPLITS)
    some = m["sessions"][0]["session"]
    assert dataset.verify(m, t.where(F.col("session") != some)) == [f"{some}: its rows are not those of the manifest"]
    assert dataset.verify(m | {"fractions": [1, 0, 0]}, t)[0].startswith("the manifest")
    assert rows(dataset.split_frame(spark, m).groupBy("split").count().select("split")) == [("calibration",), ("test",), ("train",)]


def test_budget_and_ranks(spark):
    values = [float(x) for x in [5, 5, 5, 4, 3, 2, 1, 1, 0, 9]]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    got = evaluate.budget_threshold(df, 300.0).first()
    assert (got.threshold, got.target_flags, got.actual_flags) == (5.0, 3, 1)
    assert evaluate.budget_threshold(df, 50.0).isEmpty()
    assert {r.point: r.value for r in evaluate.nearest_rank(df, "score", (0.0, 0.5, 1.0)).collect()} == {0.0: 0.0, 0.5: 4.0, 1.0: 9.0}
    at = {r.value: r.ecdf for r in evaluate.ecdf(spark.createDataFrame([(-1.0,), (1.0,), (4.5,), (99.0,)], "value double"), "value", df, "score").collect()}
    assert at == {-1.0: 0.0, 1.0: 0.3, 4.5: 0.6, 99.0: 1.0}
    none = spark.createDataFrame([(None, None)], "a boolean, b boolean")
    assert tuple(evaluate.agreement(none, "a", "b").first()) == (0, 0, 0, 1, None)


def test_tails_are_taken_over_all_features(spark, sf):
    import numpy as np

    import __spark_entry__ as entry
    from sluicebox.sources import table

    t = table(spark, sf, "transactions").join(table(spark, sf, "split_sessions"), "session").dropna(subset=list(features.FEATURES)).toPandas()
    train, test = (t[t.split_name == s] for s in ("train", "test"))
    got = {}
    for r in entry.queries()["tail_percentiles_all"](spark, sf).collect():
        got.setdefault(r.event_id, []).append((-r.extremeness, r.feature, r.training_percentile))
    assert {e.strip().lower() for e in test.event_id} == set(got)
    for _, row in test.iterrows():
        want = []
        for f in features.FEATURES:
            ref, v = train[f].to_numpy(dtype=float), float(row[f])
            p = (np.sum(ref < v) + 0.5 * np.sum(ref == v)) / len(ref)
            want.append((-round(abs(p - 0.5) * 2, 4), f, round(p, 4)))
        assert [(f, p) for _, f, p in sorted(got[row.event_id.strip().lower()])] == [(f, pytest.approx(p, abs=1.01e-4)) for _, f, p in sorted(want)[:3]]


def test_grids_are_those_of_numpy(spark):
    import numpy as np

    data = [(float(i * i % 37), i % 5) for i in range(58)]
    points = tuple(k / 100 for k in range(101))
    got = {(r.feature, r.point): r.value for r in evaluate.quantile_grids(spark.createDataFrame([*data, (None, None)], "a double, b int"), ("a", "b"), points).collect()}
    for i, name in enumerate("ab"):
        assert [got[name, p] for p in points] == pytest.approx(list(np.quantile([r[i] for r in data], points)))
    assert len(got) == 202


# ---------------------------------------------------------------- models


def numbers(spark, n=400):
    rng = random.Random(5)
    data = [(f"t{i}", rng.randrange(1, 4), rng.randrange(1, 4), rng.randrange(10**4, 10**6), rng.randrange(100, 5000), rng.randrange(100, 400), rng.uniform(1, 9), 1, rng.random(), rng.random() < 0.6) for i in range(n)]
    data += [("odd", 300, 300, 10**12, 10**8, 90_000, 4000.0, 200, 1.0, True), ("null", 1, 1, 1, 1, 1, 1.0, 1, 0.5, None)]
    return spark.createDataFrame(data, "txid string, n_in int, n_out int, value_out_sat bigint, fee_sat bigint, vsize int, fee_rate_sat_vb double, max_equal_output_count int, round_amount_fraction double, rbf_signaled boolean")


def test_forest(spark):
    df = numbers(spark)
    one, two = forest.fit(df), forest.fit(df.repartition(7))
    assert one.digest == two.digest and one.digest != forest.fit(df, seed=8).digest
    got = {r.txid: r.score for r in forest.score(df, forest.Forest.from_json(one.to_json())).collect()}
    assert got["null"] is None and max((s, t) for t, s in got.items() if s)[1] == "odd"
    assert all(0 < s < 1 for s in got.values() if s is not None)
    with pytest.raises(ValueError):
        forest.fit(df.limit(5))


def test_choose_cuts_against_all_pairs():
    from fractions import Fraction

    def brute(counts):
        total, best = sum(counts), None
        for i in range(1, len(counts) - 1):
            for j in range(i + 1, len(counts)):
                parts = sum(counts[:i]), sum(counts[i:j]), sum(counts[j:])
                miss = sum(abs(p - Fraction(f) * total) for p, f in zip(parts, ("0.6", "0.2", "0.2")))
                best = min(best or (miss, i, j), (miss, i, j))
        return best[1:]

    draw = random.Random(5)
    for _ in range(300):
        counts = [draw.choice((0, 1, 5, draw.randrange(200))) for _ in range(draw.randrange(3, 12))]
        assert dataset.choose_cuts(counts) == brute(counts)


def test_cases_are_consistent(spark):
    made = sweep.cases(spark, seed=3, variants=4)
    for r in made.select("family", "severity", F.to_json("entry").alias("e")).collect():
        tx = json.loads(r.e)
        ins, outs = [i["prevout"]["value"] for i in tx["vin"]], [o["value"] for o in tx["vout"]]
        assert min(ins) > 0 and sum(ins) == sum(outs) + tx["fee"]
        assert len(set(outs)) == len(outs) - (r.severity - 1 if r.family == "equal_outputs" else 0)
        assert tx["weight"] == 4 * round(10.5 + 68 * len(ins) + 31 * len(outs))
    assert rows(made.select("case_id", F.to_json("entry"))) == rows(sweep.cases(spark, seed=3, variants=4).select("case_id", F.to_json("entry")))


def test_sweep(spark):
    screened = sweep.screened_cases(spark)
    assert screened.count() == 20 * 39 and screened.where("not rules_match_expected").isEmpty()
    model = forest.fit(numbers(spark))
    calibration = forest.score(numbers(spark), model).where("score is not null").select("score")
    table = sweep.roll_up(sweep.run(spark, model, 0.5, calibration))
    assert table.count() == 39 and table.agg(F.sum("cases")).first()[0] == 780


def test_registry(tmp_path):
    r = registry.Registry(tmp_path / "log.jsonl")
    plain = registry.bundle_of_rules()
    good = {"rate_ratio": 1.1, "worst_benign_rate": 0.05, "rule_scope_rate": 0.95, "deterministic": True}
    first, second = (registry.bundle_of_forest(f"{{{n}}}", 0.5, good, forest.INPUTS) for n in (1, 2))
    weak = registry.bundle_of_forest("{3}", 0.5, good | {"worst_benign_rate": 0.5}, forest.INPUTS)
    for b in (plain, first, second, weak):
        r.register(b)
    with pytest.raises(ValueError):
        r.register(plain)
    r.promote(plain, "start")
    r.promote(first, "better")
    with pytest.raises(ValueError, match="benign"):
        r.promote(weak, "try")
    assert r.state.champion == first["detector_id"] and r.rollback("worse") == plain["detector_id"]
    with pytest.raises(ValueError):
        r.rollback("again")
    folder = registry.write_bundle(tmp_path, second, "{2}")
    assert registry.load_bundle(folder, forest.INPUTS)[1] == "{2}"
    (folder / "model.json").write_text("{9}")
    with pytest.raises(ValueError):
        registry.load_bundle(folder)


# ---------------------------------------------------------------- sources and sinks


def test_capture_files(spark, tmp_path):
    from sluicebox.sources import captures, sinks

    path = tmp_path / "messages.jsonl"
    with sinks.CaptureFile(path, max_bytes=400) as f:
        assert f.append({"schema_version": 1, "message_id": "m", "raw_text": "ä", "received_at": "t"})
        assert f.append({"schema_version": 1, "message_id": 5})
        assert not f.append({"x": "y" * 400})
    with pytest.raises(FileExistsError):
        sinks.CaptureFile(path)
    with path.open("a") as f:
        f.write("\nnot json\n")
    packed = sinks.pack(path)
    assert not path.exists()
    good, bad = captures.envelopes(captures.raw_lines(spark, str(packed)))
    assert [(r.message_id, r.raw_text) for r in good.collect()] == [("m", "ä")] and bad.count() == 2
    sinks.write_summary(tmp_path / "s.json", {"a": 1})
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 1}


def test_session_summaries(spark, tmp_path):
    from sluicebox.sources import captures

    (tmp_path / "live-1").mkdir()
    gaps = [{"start": "2026-03-01T00:00:00Z", "end": "2026-03-01T00:00:01.5+00:00"}, {"start": "2026-03-01T00:00:00"}]
    (tmp_path / "live-1" / "summary.json").write_text(json.dumps({"run_id": "r", "config": {"url": "u"}, "started_at": "2026-03-01T00:00:00Z", "elapsed_seconds": 5.0, "gaps": gaps, "event_counts": {"added": 3}}, indent=1))
    r = captures.session_summaries(spark, str(tmp_path / "*" / "summary.json")).first()
    assert (r.session, r.recorded_gaps, r.recorded_gap_seconds, r.events_added, r.events_mined, r.ended_at) == ("live-1", 2, 1.5, 3, 0, None)


def test_archive_keeps_what_it_has(spark):
    from sluicebox.sources import sinks

    path = scratch(spark, "archive")
    S = "message_id string, raw_text string"
    verdicts = lambda data: sorted((r.message_id, r.verdict) for r in sinks.archive(spark, spark.createDataFrame(data, S), path).collect())
    assert verdicts([("a", '{"x":1,"y":2}'), ("b", "1")]) == [("a", "new"), ("b", "new")]
    assert verdicts([("a", '{"y": 2, "x": 1}'), ("b", "2"), ("c", "3"), (None, "4")]) == [("a", "duplicate"), ("b", "conflict"), ("c", "new")]
    assert rows(spark.read.parquet(path).select("message_id", "raw_text"))[1] == ("b", "1")
    k = sinks.kafka_rows(spark.createDataFrame([("s", "r", "m"), ("", None, "m")], "session_id string, run_id string, message_id string"))
    assert [r.key for r in k.collect()] == ["s", "m"]


def test_pending_and_fallback(spark):
    from sluicebox.sources import captures

    s = spark.createDataFrame([("live-20260301T000000Z",), ("live-20260302T000000Z",), ("odd",)], "session string")
    done = s.where("session = 'odd'")
    assert captures.pending(s, done).count() == 2
    assert [r.session for r in captures.pending(s, done, on="2026-03-02").collect()] == ["live-20260302T000000Z"]
    assert rows(captures.sessions_without(done, s)) == [("live-20260301T000000Z",), ("live-20260302T000000Z",)]


def test_enrichment(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, None), (None, None, 2)], "k string, x int, y int")
    got = rows(enrichment.fill(df, spark.createDataFrame([("a", 9, 9), ("b", 7, None), ("b", 8, 1)], "k string, x int, y int"), "k", ("x", "y")))
    assert got == [("a", 1, 9), ("b", 7, None), (None, None, 2)]
    assert [r.decision for r in enrichment.decisions(df, "k", ("x",)).collect()] == ["complete", "ask", "skip"]
    asked = []
    found = enrichment.lookup_with_budget(df, "k", lambda k: asked.append(k) or {"x": 5}, "x int", 1)
    assert asked == ["a"] and rows(found) == [("a", 5)]


def test_marts_and_command_line(spark, sf, tmp_path, capsys):
    from sluicebox.plans import marts, views

    done = marts.build_marts(spark, sf, str(tmp_path / "marts"))
    assert done["fct_transactions"] > 0 and set(done) >= {"dim_capture_sessions", "fct_outcomes_by_flag"}
    assert views.as_json_rows(views.run_query(spark, sf, "capture_coverage"))["columns"][0] == "session"
    with pytest.raises(ValueError, match="hourly_flag_rate"):
        views.query_text("no such query")


def test_process_counts(spark):
    data = corpus()
    order = spark.createDataFrame([(*m, i) for i, m in enumerate(data + data[:1])], MESSAGE + ", line int")
    events, feature_rows, summary = normalise.process(order, ["line"])
    s = summary.first()
    assert (s.deliveries, s.duplicate_messages, s.conflicting_messages) == (13, 1, 2)
    assert s.events_added == 30 and s.events_removed == 20 and events.count() == 50
    assert s.features_written == feature_rows.count() == s.features_written and s.features_written + s.duplicate_added + s.conflicting_features == 30


def test_percentiles_and_tails_over_ranges(spark):
    import numpy as np

    draw = random.Random(2)
    values = [draw.choice((1.0, 2.0, 2.0, round(draw.random() * 9, 2))) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(6)
    points = (0.0, 0.1, 0.5, 0.77, 0.99, 1.0)
    got = {r.point: r.value for r in evaluate.percentiles(df, "x", points).collect()}
    assert got == pytest.approx({p: float(np.quantile(values, p)) for p in points})
    asked = spark.createDataFrame([(i, v, -v) for i, v in enumerate((-1.0, 1.0, 2.0, 3.33, 99.0))], "k int, x double, y double")
    both = df.where("x is not null").withColumn("y", -F.col("x"))
    tails = {(r.k, r.feature): r.training_percentile for r in evaluate.tail_positions(asked, both, "k", ("x", "y")).collect()}
    for k, v in enumerate((-1.0, 1.0, 2.0, 3.33, 99.0)):
        rank = (sum(x < v for x in values) + 0.5 * sum(x == v for x in values)) / len(values)
        assert tails[k, "x"] == pytest.approx(rank, abs=1e-4) and tails[k, "y"] == pytest.approx(1 - rank, abs=1e-4)
    assert evaluate.percentiles(df.limit(0), "x", points).isEmpty()


def test_alerts_of_each_worker(spark):
    from sluicebox.streaming import lake as stream

    rows_ = [(w, datetime(2026, 1, 1, 0, m, tzinfo=timezone.utc), w != "a", 0, 0.0, 0) for w in "ab" for m in range(6)]
    samples = spark.createDataFrame(rows_, "worker string, at timestamp, up boolean, lag bigint, age_seconds double, quarantined bigint")
    got = stream.alerts(samples, by=("worker",)).select("worker", "alert").distinct()
    assert rows(got) == [("a", "down")]


def test_scratch_is_removed(spark):
    from sluicebox.session import clear_scratch, forget, hadoop_path, stored

    one, two = stored(spark.range(3), "one"), stored(spark.range(3), "two")
    there = lambda t: (lambda f: f[0].exists(f[1]))(hadoop_path(spark, t._written_to))
    forget(one)
    assert not there(one) and there(two)
    clear_scratch(spark)
    assert not there(two) and clear_scratch(spark) == 0


def test_records_that_hold_no_envelope_are_kept(spark):
    import base64

    from sluicebox.sources import captures

    values = [json.dumps({"message_id": "a", "schema_version": 1}).encode(), b"\xff\xfe{}", b"[1", None, b"", json.dumps({"schema_version": "x"}).encode()]
    records = spark.createDataFrame([(None if v is None else bytearray(v), 0, i, datetime(2026, 1, 1)) for i, v in enumerate(values)], "value binary, partition int, offset bigint, timestamp timestamp")
    assert rows(captures.decoded(records).select("message_id", "kafka_offset")) == [("a", 0)]
    bad = {r.kafka_offset: (r.reason, r.value_base64) for r in captures.undecodable(records).collect()}
    assert set(bad) == {1, 2, 3, 4, 5} and bad[3] == ("no value", None) and bad[1] == ("not UTF-8", base64.b64encode(values[1]).decode())


def test_fallback_sessions(spark):
    from sluicebox.sources import captures

    lake = spark.createDataFrame([("a", 1)], "session string, n int")
    other = spark.createDataFrame([("a", 9, "x"), ("b", 2, "y")], "session string, n int, more string")
    assert rows(captures.with_fallback(lake, other)) == [("a", 1, None), ("b", 2, "y")]


def test_changed_bundles_are_neither_promoted_nor_gone_back_to(tmp_path):
    good = {"rate_ratio": 1.1, "worst_benign_rate": 0.05, "rule_scope_rate": 0.95, "deterministic": True}
    r = registry.Registry(tmp_path / "log.jsonl")
    first, second = (registry.bundle_of_forest(f"{{{n}}}", 0.5, good, forest.INPUTS) for n in (1, 2))
    folder = registry.write_bundle(tmp_path, first, "{1}")
    for b in (first, second):
        r.register(b)
    with pytest.raises(ValueError, match="changed"):
        r.promote(first | {"threshold": 0.1}, "try")
    r.promote(first, "start")
    r.promote(second, "better")
    (folder / "model.json").write_text("{9}")
    with pytest.raises(ValueError):
        r.rollback("worse", tmp_path)
    assert r.state.champion == second["detector_id"]
    (folder / "model.json").write_text("{1}")
    assert r.rollback("worse", tmp_path) == first["detector_id"]
