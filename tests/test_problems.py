"""Problems 2 to 5 on small fixtures: nulls, ties, repetitions, empty tables, clashing names."""

import json
import random
from datetime import datetime, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sluicebox.operators import changefeed, compaction, redelivery, table_diff
from sluicebox.session import scratch


def at(minute, second=0):
    return datetime(2026, 3, 1, 0, minute, second, tzinfo=timezone.utc)


# ---------------------------------------------------------------- changes

FEED = "event_id string, txid string, event_type string, event_time timestamp, source_sequence bigint, patch string"


def state(spark, feed, base=None, **kw):
    df = spark.createDataFrame([(*r, "clashing column") for r in feed], FEED)
    return {r.txid: (r.event_id, r.event_type) for r in changefeed.current_state(df, base, **kw).collect()}


def test_last_change_wins_whatever_the_order(spark):
    feed = [("e1", "A", "added", at(1), 5), ("e2", "a ", "mined", at(3), 6), ("e3", "a", "replaced", at(2), 9), ("e4", "b", "added", at(1), None), ("e5", "b", " Removed", at(2), None), ("e6", "c", "removed", at(1), 1), ("e7", "C", "ADDED", at(2), 1)]
    want = {"a": ("e2", "mined"), "c": ("e7", "added")}
    assert state(spark, feed) == want
    assert state(spark, feed[::-1] * 3) == want


def test_ties_by_sequence_rank_and_id(spark):
    assert state(spark, [("e1", "t", "added", at(1), 7), ("e2", "t", "mined", at(1), 6)]) == {"t": ("e1", "added")}
    assert state(spark, [("e1", "t", "mined", at(1), None), ("e2", "t", "added", at(1), 0)]) == {"t": ("e2", "added")}
    assert state(spark, [("e2", "t", "mined", at(1), 1), ("e1", "t", "replaced", at(1), 1)]) == {"t": ("e2", "mined")}
    assert state(spark, [("e2", "t", "mined", at(1), 1), ("e1", "t", "mined", at(1), 1)]) == {"t": ("e1", "mined")}


def test_a_repeated_event_counts_at_its_earliest_time(spark):
    feed = [("e1", "t", "removed", at(1), 1), ("e2", "t", "added", at(2), 1), (" E1", "t", "removed", at(9), 1)]
    assert state(spark, feed) == {"t": ("e2", "added")}


def test_no_changes(spark):
    assert state(spark, [("e", None, "added", at(1), 1), ("f", "t", "added", None, 1), ("g", "t", "seen", at(1), 1), ("h", "t", None, at(1), 1)]) == {}
    assert state(spark, []) == {}
    assert state(spark, [(None, "t", "added", at(1), 1), (None, "u", "added", at(1), 1)]) == {"t": (None, "added"), "u": (None, "added")}


def test_batches_give_the_same_as_one_feed(spark):
    feed = [(f"e{i}", f"t{i % 7}", ("added", "removed", "mined", "replaced")[i % 4], at(i * 7 % 11), i % 3 or None) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in feed], FEED)
    one = rows(changefeed.current_state(df))
    half = changefeed.state_with_tombstones(df.where(F.xxhash64("event_id") % 2 == 0))
    both = changefeed.current_state(df.where(F.xxhash64("event_id") % 2 != 0), half)
    assert rows(both) == one


def batched(spark, *batches):
    kept = None
    for b in batches:
        kept = changefeed.changes_kept(spark.createDataFrame([(*r, "x") for r in b], FEED), kept)
    return {r.txid: (r.event_id, r.event_type) for r in changefeed.current_state(spark.createDataFrame([], FEED), kept).collect()}


def test_batches_may_repeat_an_event_at_another_time(spark):
    mined, removed = ("e0", "t", "mined", at(5), 1), ("e1", "t", "removed", at(9), 1)
    earlier, later = ("e1", "t", "removed", at(1), 1), ("e0", "t", "mined", at(20), 1)
    assert state(spark, [mined, removed, earlier]) == batched(spark, [mined, removed], [earlier]) == {"t": ("e0", "mined")}
    assert state(spark, [mined, removed, later]) == batched(spark, [mined, removed], [later]) == {}
    tie = [("e2", "t", "added", at(1), 1), ("e2", "t", "mined", at(1), 2), ("e3", "t", "removed", at(1), 1)]
    assert state(spark, tie) == batched(spark, tie[:1], tie[1:]) == batched(spark, tie[1:], tie[:1]) == {"t": ("e2", "mined")}


def replay(changes, kinds=changefeed.Kinds()):
    """Change after change on a plain dictionary: what the operator must give."""
    first = {}
    for e, k, op, t, q, f in changes:
        if k is None or t is None or op not in kinds.operations:
            continue
        form = (t, q is None, -(q or 0), -kinds.operations.index(op), k, f is not None, f or "")
        if e not in first or form < first[e][0]:
            first[e] = (form, (t, q is not None, q or 0, kinds.operations.index(op)), e, k, op, f)
    table = {}
    for *_, e, k, op, f in sorted(sorted(first.values(), key=lambda x: x[2], reverse=True), key=lambda x: x[1]):
        row = table.get(k, (None, None, None))
        if op in kinds.deletes:
            table[k] = (e, op, None)
        else:
            table[k] = (e, op, f if f is not None or op in kinds.inserts else row[2])
    return {k: v for k, v in table.items() if v[1] not in kinds.deletes}


@pytest.mark.parametrize("seed", range(3))
def test_any_batching_is_a_replay(spark, seed, monkeypatch):
    """Redeliveries at other times, ties, fields that come and go, own names of operations, one hot key."""
    monkeypatch.setattr(changefeed, "RUNS", 2)
    draw = random.Random(seed)
    kinds = changefeed.Kinds(("new", "gone", "set", "fixed"), ("new",), ("gone",), ("patch",))
    made = []
    for _ in range(120):
        key = draw.choice("aaaabcd")
        made.append((f"e{draw.randrange(60)}", key, draw.choice(("new", "gone", "set", "set", "fixed", "other")), at(draw.randrange(12)), draw.choice((None, 1, 2)), draw.choice((None, "x", "y", "z"))))
    schema = "event_id string, txid string, event_type string, event_time timestamp, source_sequence bigint, patch string"
    kept = changefeed.ChangeTable(spark, scratch(spark, "t"), kinds, broadcast_ids=0 if seed == 0 else changefeed.BROADCAST_IDS)
    cuts = [0, *sorted(draw.sample(range(1, 120), 3)), 120]
    for a, b in zip(cuts, cuts[1:]):
        kept.apply(spark.createDataFrame(made[a:b], schema))
    got = {r.txid: (r.event_id, r.event_type, r.patch) for r in changefeed.ChangeTable(spark, kept.root, kinds).rows().collect()}
    assert got == replay(made, kinds)


def test_own_operations_without_a_table(spark):
    df = spark.createDataFrame([("e", "k", "new", at(1), 1, "x"), ("f", "j", "new", at(1), 1, "x"), ("g", "j", "gone", at(2), 1, "x")], FEED)
    assert rows(changefeed.current_state(df, operations=("new", "gone"), deletes=("gone",)).select("txid", "event_type")) == [("k", "new")]


def test_a_dead_batch_of_changes_leaves_the_table(spark, monkeypatch):
    kept = changefeed.ChangeTable(spark, scratch(spark, "t"))
    assert kept.rows() is None
    kept.apply(spark.createDataFrame([("e", "k", "added", at(1), 1, "x")], FEED))
    with monkeypatch.context() as m:
        m.setattr(changefeed, "write_atomically", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.apply(spark.createDataFrame([("f", "ghost", "added", at(1), 1, "x")], FEED))
    again = changefeed.ChangeTable(spark, kept.root)
    again.apply(spark.createDataFrame([], FEED))
    assert [r.txid for r in again.rows().collect()] == ["k"]


# ---------------------------------------------------------------- differences

COPY = "k string, s string, at timestamp, x double, n int, tags array<string>, l int"


def found(spark, left, right, **kw):
    a, b = (spark.createDataFrame(r, COPY) for r in (left, right))
    return rows(table_diff.findings(table_diff.diff(a, b, ["s", "k"], ids=("k",), **kw), ["s", "k"]))


def test_differences_field_by_field(spark):
    row = ("A ", "s", at(1), 1.0, 1, ["x", "y"], 1)
    assert found(spark, [row, row], [("a", "s", at(1), 1.0 + 5e-7, 1, ["y", "x", "x"], 1)]) == []
    assert found(spark, [row], [("a", "s", at(2), 1.1, None, ["x"], 1)]) == [("s", "a", c) for c in ("at", "n", "tags", "x")]
    assert found(spark, [row], []) == [("s", "a", "only_in_left")]
    assert found(spark, [], [row] * 3, names=("a", "b")) == [("s", "a", "only_in_b")]
    assert found(spark, [], []) == []


def test_differences_of_nulls(spark):
    a = (None, None, None, None, None, None, None)
    assert found(spark, [a], [a]) == []
    assert found(spark, [a], [(None, None, None, float("nan"), None, [], None)]) == [(None, None, "x")]
    assert found(spark, [(None, "s", at(1), float("nan"), 1, [], 1)], [(None, "s", at(1), float("nan"), 1, None, 1)]) == []
    assert found(spark, [("a", None, at(1), 1.0, 1, [], 1)], [("a", "s", at(1), 1.0, 1, [], 1)]) == [("s", "a", "only_in_right"), (None, "a", "only_in_left")]


def test_several_rows_of_a_key_are_reported(spark):
    row = ("a", "s", at(1), 1.0, 1, ["x"], 1)
    assert found(spark, [row, ("a", "s", at(1), 1.0, 2, ["x"], 1)], [row]) == [("s", "a", "several_rows")]
    assert found(spark, [row, ("a", "s", at(1), 1.5, 1, ["x"], 1)], [row, row]) == [("s", "a", "several_rows")]
    assert found(spark, [row, ("A ", "s", at(1), 1.0 + 5e-7, 1, ["x", "x"], 1)], [row]) == []
    assert found(spark, [row, ("a", "s", at(1), None, 1, ["x"], 1)], []) == [("s", "a", "only_in_left"), ("s", "a", "several_rows")]
    nan = ("a", "s", at(1), float("nan"), 1, ["x"], 1)
    assert found(spark, [nan, nan], [nan]) == []
    a, b = (spark.createDataFrame(r, COPY) for r in ([row, ("a", "s", at(1), 1.0, 2, ["x"], 1)], [row]))
    d = table_diff.diff(a, b, ["s", "k"]).first()
    assert [tuple(x) for x in d.differences] == [("several_rows", "2", "1")]


def test_differences_carry_both_values(spark):
    a, b = (spark.createDataFrame([("k", "s", at(1), 1.0, n, None, 1)], COPY) for n in (1, 2))
    d = table_diff.diff(a, b, ["s", "k"]).first()
    assert [tuple(x) for x in d.differences] == [("n", "1", "2")]
    assert table_diff.schema_difference(a, b.drop("l")) == [("l", "int", None)]


# ---------------------------------------------------------------- redelivery

DELIVERY = "message_id string, received_at string, kafka_partition int, kafka_offset bigint, item_id string"


def feed():
    from sluicebox.plans.problems import message_feed

    return message_feed("message_id", "received_at", "kafka_partition", "kafka_offset", "item_id")


def test_batches_keep_one_row_of_each_id(spark):
    store = redelivery.DeliveryStore(spark, scratch(spark, "t"), feed())
    first = [("A", "2026-03-02T00:00:00Z", 0, 1, "x"), (" a", "2026-03-02T00:00:00Z", 0, 2, "x"), ("b", None, 0, 3, None), ("c", "2026-03-01T00:00:00", 1, 1, None), (None, "2026-03-01T00:00:00Z", 1, 2, None), (" ", None, 1, 3, None)]
    assert store.merge(spark.createDataFrame(first, DELIVERY)) == ["2026-03-02", "none"]
    assert sorted((r.item_id, r.n_rows, r.ord.o3) for r in store.winners().collect()) == [("a", 2, 1), ("b", 1, 3), ("c", 1, 1)]
    # An earlier delivery moves a's row to another day; c's partition isn't touched by d.
    assert store.merge(spark.createDataFrame([("a", "2026-03-01T23:00:00Z", 2, 9, "y"), ("d", "2026-03-05T00:00:00Z", 2, 10, None)], DELIVERY)) == ["2026-03-01", "2026-03-02", "2026-03-05"]
    assert sorted((r.item_id, r.n_rows, r.ord.o3, r.part) for r in store.winners().collect()) == [("a", 3, 9, "2026-03-01"), ("b", 1, 3, "none"), ("c", 1, 1, "none"), ("d", 1, 10, "2026-03-05")]
    assert {r.message_id for r in store.rows().collect()} == {"a", "b", "c", "d"}
    again = redelivery.DeliveryStore(spark, store.root, store.feed)
    assert again.version == 1 and rows(again.winners().select("item_id")) == rows(store.winners().select("item_id"))
    assert again.merge(spark.createDataFrame([], DELIVERY)) == [] and again.version == 1


def test_a_batch_without_a_manifest_leaves_the_store_as_it_was(spark, monkeypatch):
    store = redelivery.DeliveryStore(spark, scratch(spark, "t"), feed())
    store.merge(spark.createDataFrame([("a", "2026-03-02T00:00:00Z", 0, 5, None)], DELIVERY))
    with monkeypatch.context() as m:
        m.setattr(redelivery, "write_atomically", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.merge(spark.createDataFrame([("a", "2026-03-01T00:00:00Z", 0, 4, None)], DELIVERY))
    again = redelivery.DeliveryStore(spark, store.root, store.feed)
    assert [r.ord.o3 for r in again.winners().collect()] == [5]
    again.merge(spark.createDataFrame([("a", "2026-03-01T00:00:00Z", 0, 4, None)], DELIVERY))
    assert [r.ord.o3 for r in again.winners().collect()] == [4]


def test_a_dead_merge_is_never_published(spark, monkeypatch):
    store = redelivery.DeliveryStore(spark, scratch(spark, "t"), feed())
    delivery = lambda i, day, offset: spark.createDataFrame([(i, f"2026-03-0{day}T00:00:00Z", 0, offset, None)], DELIVERY)
    store.merge(delivery("a", 1, 1))
    with monkeypatch.context() as m:
        m.setattr(redelivery, "write_atomically", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.merge(delivery("ghost", 2, 2))
    again = redelivery.DeliveryStore(spark, store.root, store.feed)
    again.merge(delivery("b", 2, 3))
    assert rows(again.winners().select("item_id")) == [("a",), ("b",)]
    assert {g.split("/")[0] for g in again.vacuum(0)} == {"data", "index"} and rows(again.winners().select("item_id")) == [("a",), ("b",)]
    assert again.vacuum(0) == []


def test_of_two_writers_the_second_merges_again(spark):
    root = scratch(spark, "t")
    delivery = lambda i, offset: spark.createDataFrame([(i, "2026-03-01T00:00:00Z", 0, offset, None)], DELIVERY)
    one, other = redelivery.DeliveryStore(spark, root, feed()), redelivery.DeliveryStore(spark, root, feed())
    one.merge(delivery("a", 1))
    with pytest.raises(FileExistsError):
        other.merge(delivery("b", 2))
    other = redelivery.DeliveryStore(spark, root, feed())
    assert rows(other.winners().select("item_id")) == [("a",)]
    other.merge(delivery("b", 2))
    assert rows(redelivery.DeliveryStore(spark, root, feed()).winners().select("item_id")) == [("a",), ("b",)]


def test_many_batches_equal_one(spark, monkeypatch):
    monkeypatch.setattr(redelivery, "RUNS", 2)
    draw = random.Random(3)
    made = [(draw.choice("abcdefgh") * draw.randrange(1, 3), draw.choice([None, *(f"2026-03-0{d}T00:00:00Z" for d in range(1, 6))]), draw.randrange(3), i, None) for i in range(60)]
    store, whole = (redelivery.DeliveryStore(spark, scratch(spark, "t"), feed()) for _ in range(2))
    for i in range(0, 60, 10):
        store.merge(spark.createDataFrame(made[i : i + 10], DELIVERY))
    whole.merge(spark.createDataFrame(made, DELIVERY))
    kept = lambda s: rows(s.winners().select("item_id", "ord.o3", "n_rows", "part"))
    assert kept(store) == kept(whole) == kept(redelivery.DeliveryStore(spark, store.root, store.feed)) and len(store.runs) <= 2


# ---------------------------------------------------------------- small files


def line(txid, session="s", received="2026-03-01T00:00:00Z", sep=(",", ":")):
    return json.dumps({"txid": txid, "session": session, "received_at": received, "fee_sat": 1}, separators=sep)


def test_consolidation_keeps_each_record_once(spark):
    bodies = [
        line("a") + "\n" + line("b", received="2026-03-03T00:00:00Z"),  # no last line end
        line("c", received="2026-03-02T00:00:00Z") + "\r\n\r\n" + line("D ") + "\r\n",
        line("a", sep=(", ", ": ")) + "\n" + line("e")[:-9],  # repeated with other spacing; cut off
        None,
        "",
        "\n\n",
        line("a", session="t") + "\n" + '{"txid": null, "session": "s"}\nnot json\n[1]\n',
    ]
    files = spark.createDataFrame([(b, i) for i, b in enumerate(bodies)], "body string, line int")
    out = scratch(spark, "files")
    totals = compaction.consolidate(spark, files.select("body"), out, target_bytes=100)
    got = compaction.consolidated_lines(spark, out)
    assert rows(compaction.keyed(got).select("session", "txid")) == [("s", "a"), ("s", "b"), ("s", "c"), ("s", "d"), ("t", "a")]
    assert totals.n_lines == 5 and totals == compaction.totals(got)
    assert {r.line for r in got.collect()} <= {x for b in bodies if b for x in b.replace("\r", "").split("\n")}
    assert compaction.rejected(files).count() == 4


def test_consolidation_notices_lost_lines(spark, monkeypatch):
    files = spark.createDataFrame([(line("a") + "\n" + line("a", sep=(", ", ": ")) + "\n" + line("b") + "\nno json",)], "body string")
    out = scratch(spark, "files")
    compaction.consolidate(spark, files, out)
    found = json.loads(spark.read.text(f"{out}/totals.json").first()[0])
    assert {k: v["n_lines"] for k, v in found.items()} == {"input": 4, "kept": 2, "surplus": 1, "rejected": 1}
    whole = compaction.unique_lines
    monkeypatch.setattr(compaction, "unique_lines", lambda *a: whole(*a).where("txid <> 'b'"))
    with pytest.raises(ValueError):
        compaction.consolidate(spark, files, scratch(spark, "files"))


def test_consolidated_files_are_few_and_in_order(spark):
    files = spark.createDataFrame([(line(f"t{i}", received=f"2026-03-01T00:{i % 60:02}:00Z"),) for i in range(200)], "body string")
    out = scratch(spark, "files")
    compaction.consolidate(spark, files, out)
    got = [json.loads(r.line)["received_at"] for r in compaction.consolidated_lines(spark, out).collect()]
    assert got == sorted(got) and len(got) == 200
    assert len(spark.read.text(f"{out}/files").inputFiles()) == 1


def test_consolidating_nothing(spark):
    out = scratch(spark, "files")
    assert compaction.consolidate(spark, spark.createDataFrame([], "body string"), out).n_lines == 0


def test_frames_are_joined_as_they_are(spark):
    import zstandard

    parts = [zstandard.ZstdCompressor().compress(f"{i}\n".encode() * 50) for i in range(20)]
    df = spark.createDataFrame([(p,) for p in parts] + [(None,), (b"",)], "data binary").coalesce(1)
    joined = compaction.join_frames(df, target_bytes=3 * len(parts[0])).collect()
    text = b"".join(zstandard.ZstdDecompressor().stream_reader(bytes(r.data), read_across_frames=True).read() for r in joined)
    assert text == b"".join(f"{i}\n".encode() * 50 for i in range(20))
    assert sum(r.n_frames for r in joined) == 20 and 1 < len(joined) < 20
    with pytest.raises(Exception, match="cut off|no zstandard"):
        compaction.join_frames(spark.createDataFrame([(parts[0][:-1],)], "data binary")).collect()


def test_bodies_are_joined_byte_for_byte(spark):
    bodies = ["a\r\nb\n", "c", "\n\n", "", None, "ü\rx\n", " \n"]
    files = spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1)
    out = scratch(spark, "joined")
    total = compaction.concatenate(spark, files, out)
    fs = spark.sparkContext.wholeTextFiles(out).values().collect()
    assert "".join(fs) == "a\r\nb\nc\n\n\nü\rx\n \n" and total.n_lines == 7


@pytest.mark.parametrize("harm", [lambda x: x.replace("b", "B"), lambda x: x + "\n", lambda x: ""])
def test_a_changed_byte_is_noticed(spark, monkeypatch, harm):
    files = spark.createDataFrame([("a\nb\n",)], "body string")
    read = compaction.joined_lines
    monkeypatch.setattr(compaction, "joined_lines", lambda *a: read(*a).select(F.explode(F.split(F.udf(harm)("line"), "\n")).alias("line")))
    with pytest.raises(ValueError, match="differ"):
        compaction.concatenate(spark, files, scratch(spark, "joined"))


def test_frames_are_written_under_names_of_their_own(spark):
    files = spark.createDataFrame([(f"{i}\n" * 30 + "x",) for i in range(40)] + [(None,), ("",)], "body string").repartition(4)
    out = scratch(spark, "frames")
    written = compaction.write_frames(compaction.compressed(files), out, target_bytes=100)
    listed = written.collect()
    assert len({r.path for r in listed}) == len(listed) > 4 and sum(r.n_frames for r in listed) == 40
    held = compaction.frame_totals(spark, written).agg(F.sum("n_lines"), F.sum("n_text_bytes")).first()
    assert tuple(held) == (40 * 31, sum(len(f"{i}\n") * 30 + 2 for i in range(40)))
    path = listed[0].path.removeprefix("file:").replace("//", "/")
    data = bytearray(open(path, "rb").read())
    data[-1] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="isn't the file|checksum|decompress"):
        compaction.frame_totals(spark, written).collect()


def test_joined_frames_have_numbers_of_their_own(spark):
    import zstandard

    parts = [(zstandard.ZstdCompressor().compress(b"x"),) for _ in range(8)]
    got = compaction.join_frames(spark.createDataFrame(parts, "data binary").repartition(4), target_bytes=1).collect()
    assert len({r.file_no for r in got}) == 8


def test_claims_are_held_against_bodies(spark):
    files = spark.createDataFrame([("a", 2, 4, "x\ny"), ("b", 2, 3, "x\ny"), ("c", 1, 3, "x\ny"), ("d", None, 0, None), ("e", 0, 0, "")], "file_path string, n_rows bigint, n_bytes bigint, body string")
    assert rows(compaction.claims(files).select("file_path", "held_rows", "held_bytes")) == [("a", 2, 3), ("c", 2, 3), ("d", 0, 0)]
