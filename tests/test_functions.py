import random

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebox.functions.ids import clean_id, iso_instant, pack_id, unpack_id
from sluicebox.functions.once import once
from sluicebox.functions.rounding import round6


def test_clean_id(spark):
    df = spark.createDataFrame([(" \tAB\r\n",), ("x y",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(clean_id(F.col("c"))).collect()] == ["ab", "x y", "", None]


def test_pack_id_round_trip(spark):
    ids = ["ab" * 32, "abc", "0x12", "", "ab", "zz", "00ff", "é" * 3, None]
    df = spark.createDataFrame([(i,) for i in ids], "c string")
    got = df.select(pack_id(F.col("c")).alias("p"), "c").select("p", unpack_id(F.col("p")).alias("u"), "c").collect()
    assert [r.u for r in got] == ids
    assert len({bytes(r.p) for r in got if r.p is not None}) == len(ids) - 1
    assert len(got[0].p) == 33


def test_iso_instant_needs_a_zone(spark):
    texts = ["2026-03-01T12:25:24.262+02:00", "2026-03-01T10:25:24.262Z", "2026-03-01T10:25:24.262", "2026-03-01T12:25:24+0200", "2026-03-01T12:25:24+02", "later", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r[0] for r in df.select(F.unix_micros(iso_instant(F.col("c")))).collect()]
    assert got[0] == got[1] and got[3] == got[4] == got[0] - 262000
    assert [g is None for g in got] == [False, False, True, False, False, True, True, True]


def test_round6_is_correct_rounding(spark):
    rng = random.Random(1)
    values = [rng.randrange(1, 200_000) / rng.choice((128, 64, 640, 1000, 3, 141)) for _ in range(20_000)]
    values += [0.0, 0.5, 1e-7, 5e-7, 0.0000005, 0.0000015, 2.5e-6, 12.5078125, 1601 / 128, 1e9 + 0.1234565, 2.0**33 + 0.3, -1.0000005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    wrong = [(r.x, r.y) for r in df.select("x", round6(F.col("x")).alias("y")).collect() if r.y != (round(r.x, 6) if abs(r.x) < 2**32 else r.x)]
    assert wrong == []


def test_once_keeps_rows_and_columns(spark):
    df = once(spark.range(3), a=F.col("id") + 1).where("a > 1")
    assert rows(df) == [(1, 2), (2, 3)]
    assert rows(once(df, a=F.col("a") * 2)) == [(1, 4), (2, 6)]


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 5))
def test_count_frames(data, n):
    import zstandard

    from sluicebox.operators.compaction import count_frames

    body = b"".join(zstandard.ZstdCompressor(write_checksum=i % 2 == 0).compress(data * (i + 1)) for i in range(n))
    assert count_frames(body) == n
    for cut in {1, len(body) // 2, len(body) - 1} - {0}:
        try:
            assert count_frames(body[:cut]) < n  # a cut between frames leaves whole ones
        except ValueError:
            pass
