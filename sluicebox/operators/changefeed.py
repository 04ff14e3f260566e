"""A feed of inserts, updates and deletes, applied in the right order (problem 5).

A change is a function on the row of its key: an insert makes a new row of the fields it gives, an update sets the
fields it gives (a null leaves a field as it is), a delete takes the row away, and each leaves its mark as the last
change. "Later" is a total order on the changes themselves (time, sequence, operation, event id), not on their arrival.

A patch is the composition of any set of changes of a key, in a form that is closed under composition: the last change,
the last one that resets the row (an insert or a delete), and for each field the last value set, each with the order of
the change that set it. Composing two patches takes the later of each part, so composition is associative, commutative
and idempotent: ranges of the feed may be composed in any grouping, in parallel. Partial aggregation is that tree: each
task composes its range of even one hot key to a single patch before anything is shuffled, the shuffle composes the
patches of all tasks, and what is left is applied to the base, which is a table of patches, too. A field holds if it was
set at or after the last reset; a key whose last change is a delete has no row.

A repeated event is one change at its earliest time, so a repetition may still move an event to an earlier time and
take back what it did later. A patch can't forget a change; `ChangeTable` therefore keeps the changes by event beside the
base and composes anew those keys whose events moved.

Defined results: null keys, null times and unknown operations are no changes; a null event id is an id of its own; an
empty feed leaves the base as it is; an empty base gives the state of the feed alone; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import clean_id, pack_id, unpack_id
from ..session import names_in, read_small, scratch, stored, write_atomically

#: Operations by precedence at one time and sequence number: the last wins. Fixed values.
OPERATIONS = ("added", "removed", "replaced", "mined")
INSERTS = ("added",)
DELETES = ("removed",)


def operation_rank(kind: Column, operations: tuple[str, ...] = OPERATIONS) -> Column:
    """1 for the weakest operation; null for an unknown one."""
    out = F.lit(None).cast("int")
    for rank, name in enumerate(operations, 1):
        out = F.when(kind == name, F.lit(rank)).otherwise(out)
    return out


def distinct_changes(
    feed: DataFrame,
    key: str = "txid",
    event: str = "event_id",
    kind: str = "event_type",
    time: str = "event_time",
    sequence: str = "source_sequence",
    operations: tuple[str, ...] = OPERATIONS,
    fields: tuple[str, ...] = (),
) -> DataFrame:
    """(e, k, t, q, r, and the fields as f): each change once, at the earliest time of its repetitions.

    Of repetitions at that earliest time the one with the greatest (sequence, operation, key) counts. A null event id
    is an id of its own here (all rows without one would else be one change): such rows stay apart and never win over
    an identified change that is otherwise equal.
    """
    rank = operation_rank(clean_id(F.col(kind)), operations)
    rows = feed.select(
        pack_id(clean_id(F.col(event))).alias("e"),
        pack_id(clean_id(F.col(key))).alias("k"),
        F.unix_micros(F.col(time)).alias("t"),
        F.col(sequence).cast("bigint").alias("q"),
        rank.alias("r"),
        _fields(fields).alias("f"),
    ).where("k is not null and t is not null and r is not null")
    return _each_once(rows)


def _fields(names: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(f"`{n}`").alias(f"f{i}") for i, n in enumerate(names)]) if names else F.lit(True)


def _form() -> Column:
    """What decides between repetitions of an event; the least counts."""
    return F.struct("t", F.isnull("q").alias("q0"), F.bitwise_not("q").alias("nq"), F.negative("r").alias("nr"), "k", "f")


def _each_once(rows: DataFrame) -> DataFrame:
    """(e, k, t, q, r, f) with one row of each event: the same choice whether the rows come at once or in batches."""
    named = rows.where("e is not null").groupBy("e").agg(F.min(_form()).alias("m"))
    named = named.select("e", "m.k", "m.t", F.bitwise_not("m.nq").alias("q"), F.negative("m.nr").alias("r"), "m.f")
    return named.unionByName(rows.where("e is null"))


# ---------------------------------------------------------------- patches


@dataclass(frozen=True)
class Kinds:
    """The operations by rising precedence, which of them reset a row and which take it away, and the fields they carry."""

    operations: tuple[str, ...] = OPERATIONS
    inserts: tuple[str, ...] = INSERTS
    deletes: tuple[str, ...] = DELETES
    fields: tuple[str, ...] = ()

    def ranks(self, names: tuple[str, ...]) -> list[int]:
        return [self.operations.index(n) + 1 for n in names]


def _order() -> Column:
    """The place of a change in the order of changes, turned round: the least is the latest."""
    return F.struct(F.bitwise_not("t").alias("nt"), F.isnull("q").alias("q0"), F.bitwise_not("q").alias("nq"), F.negative("r").alias("nr"), F.isnull("e").alias("e0"), unpack_id(F.col("e")).alias("e"))


def patches(changes: DataFrame, kinds: Kinds = Kinds()) -> DataFrame:
    """k and its patch: last, and with fields also reset and set0, set1, ...: one row per key."""
    at = _order()
    made = [at.alias("last")]
    if kinds.fields:
        deletes = F.col("r").isin(kinds.ranks(kinds.deletes))
        made.append(F.when(F.col("r").isin(kinds.ranks((*kinds.inserts, *kinds.deletes))), at).alias("reset"))
        for i in range(len(kinds.fields)):
            made.append(F.when(~deletes & F.col(f"f.f{i}").isNotNull(), F.struct(at.alias("at"), F.col(f"f.f{i}").alias("value"))).alias(f"set{i}"))
    return compose(changes.select("k", *made))


def compose(some: DataFrame) -> DataFrame:
    """Patches of the same keys composed, whatever the feed and the grouping they come from: one row per key."""
    return some.groupBy("k").agg(*[F.min(c).alias(c) for c in some.columns if c != "k"])


def rows_of(table: DataFrame, kinds: Kinds = Kinds(), tombstones: bool = False) -> DataFrame:
    """The rows that patches make of nothing: txid, event_id, event_type, event_time, source_sequence, fields."""
    last = table.select(
        unpack_id(F.col("k")).alias("txid"),
        F.col("last.e").alias("event_id"),
        F.element_at(F.array(*map(F.lit, kinds.operations)), F.negative("last.nr")).alias("event_type"),
        F.timestamp_micros(F.bitwise_not("last.nt")).alias("event_time"),
        F.bitwise_not("last.nq").alias("source_sequence"),
        *[F.when(F.col("reset").isNull() | (F.col(f"set{i}.at") <= F.col("reset")), F.col(f"set{i}.value")).alias(n) for i, n in enumerate(kinds.fields)],
    )
    return last if tombstones else last.where(~F.col("event_type").isin(*kinds.deletes))


# ---------------------------------------------------------------- feeds at once, or with a base


def current_state(feed: DataFrame, base: DataFrame | None = None, deletes: tuple[str, ...] = DELETES, operations: tuple[str, ...] = OPERATIONS, **columns: str) -> DataFrame:
    """(txid, event_id, event_type, event_time, source_sequence) of the keys that exist after the feed.

    base: what `changes_kept` gave of the feed so far; the result is that of the whole feed at once, whatever is
    repeated, late, or deleted in between. A base of states alone (of `state_with_tombstones`) holds the last change of
    each key only, which is enough just as long as no event is repeated in another batch.
    """
    return rows_of(patches(_changes(feed, base, operations, **columns)), Kinds(operations, (), deletes))


def state_with_tombstones(feed: DataFrame, base: DataFrame | None = None, operations: tuple[str, ...] = OPERATIONS, **columns: str) -> DataFrame:
    """As current_state, with deleted keys still there, by their last change."""
    return rows_of(patches(_changes(feed, base, operations, **columns)), Kinds(operations, (), ()), tombstones=True)


def changes_kept(feed: DataFrame, base: DataFrame | None = None, operations: tuple[str, ...] = OPERATIONS, **columns: str) -> DataFrame:
    """Each change of the feed and of the base once, in the columns of the state: the plainest form to keep between batches."""
    changes = _changes(feed, base, operations, **columns)
    return changes.select(
        unpack_id(F.col("k")).alias("txid"),
        unpack_id(F.col("e")).alias("event_id"),
        F.element_at(F.array(*map(F.lit, operations)), F.col("r")).alias("event_type"),
        F.timestamp_micros(F.col("t")).alias("event_time"),
        F.col("q").alias("source_sequence"),
    )


def _changes(feed: DataFrame, base: DataFrame | None, operations: tuple[str, ...], **columns: str) -> DataFrame:
    changes = distinct_changes(feed, operations=operations, **columns)
    if base is None:
        return changes
    held = base.select(
        pack_id(clean_id(F.col("event_id"))).alias("e"),
        pack_id(clean_id(F.col("txid"))).alias("k"),
        F.unix_micros("event_time").alias("t"),
        F.col("source_sequence").alias("q"),
        operation_rank(F.col("event_type"), operations).alias("r"),
        F.lit(True).alias("f"),
    )
    return _each_once(changes.unionByName(held))


# ---------------------------------------------------------------- a table kept from batch to batch

#: Hashes of ids that are broadcast at most (8 bytes each); beyond it the same joins go by shuffle.
BROADCAST_IDS = 1_000_000
#: Runs of the log before they are joined.
RUNS = 8


class ChangeTable:
    """The current table, kept in a folder and moved on batch by batch; any cutting of a feed into batches ends alike.

    The folder holds the base (a patch for each key), the log (the changes of each batch, each event once in its run),
    and numbered manifests that name both; each is published once and only when its files are whole, so a batch that
    dies leaves the table as it was. A batch costs its own size and one pass over base and log: the rows of keys and
    events outside the batch are never shuffled while the batch's ids are within BROADCAST_IDS, whose number is counted
    before it is used.
    """

    def __init__(self, spark: SparkSession, root: str, kinds: Kinds = Kinds(), broadcast_ids: int = BROADCAST_IDS, **columns: str):
        self.spark, self.root, self.kinds, self.columns, self.most = spark, root.rstrip("/"), kinds, columns, broadcast_ids
        self.version, self.manifest = -1, {"base": None, "log": []}
        numbers = [int(n.split(".")[0]) for n in names_in(spark, f"{self.root}/manifests")]
        if numbers:
            self.version = max(numbers)
            self.manifest = json.loads(read_small(spark, f"{self.root}/manifests/{self.version}.json"))

    def _write(self, df: DataFrame, kind: str) -> dict:
        path = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return {"path": path, "schema": df.schema.jsonValue()}

    def _read(self, *written: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(written[0]["schema"])).parquet(*[w["path"] for w in written])

    def rows(self, tombstones: bool = False) -> DataFrame | None:
        """The table as it stands; None before any batch."""
        base = self.manifest["base"]
        return rows_of(self._read(base), self.kinds, tombstones) if base else None

    def apply(self, feed: DataFrame) -> None:
        """Apply one batch of the feed."""
        run = self._write(distinct_changes(feed, operations=self.kinds.operations, fields=self.kinds.fields, **self.columns), "log")
        log = [*self.manifest["log"], run]
        table = self._moved_on(self._read(run), log) if self.manifest["base"] else patches(self._read(run), self.kinds)
        base = self._write(table, "base")
        if len(log) > RUNS:
            log = [self._write(_each_once(self._read(*log)), "log")]
        manifest = {"base": base, "log": log}
        write_atomically(self.spark, f"{self.root}/manifests/{self.version + 1}.json", json.dumps(manifest))
        self.version, self.manifest = self.version + 1, manifest

    def _among(self, df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
        """df semi- or anti-joined by the hash of a column. ids: h, written. A clash of hashes only adds to the semi side."""
        some = F.broadcast(ids) if ids.count() <= self.most else ids
        return df.withColumn("h", F.xxhash64(column)).join(some, "h", how).drop("h")

    def _ids(self, df: DataFrame, column: str) -> DataFrame:
        return stored(df.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h")).distinct(), "change-ids")

    def _moved_on(self, fresh: DataFrame, log: list[dict]) -> DataFrame:
        """The patches of all keys after a batch of changes."""
        held = self._among(self._read(*log[:-1]).where("e is not null"), "e", self._ids(fresh, "e"), "left_semi")
        old = _each_once(held).select("e", _form().alias("old"))
        seen = stored(fresh.where("e is not null").select("e", _form().alias("new")).join(old, "e"), "change-repeats")
        # A repetition that isn't earlier changes nothing; an earlier one takes the event's old change back.
        new = fresh.join(seen.where("new >= old").select("e"), "e", "left_anti")
        add = patches(new, self.kinds)
        base = self._read(self.manifest["base"])
        back = self._ids(seen.where("new < old").select(F.col("old.k").alias("k")), "k")
        if not back.isEmpty():
            every = self._read(*log)
            theirs = stored(self._among(every, "k", back, "left_semi"), "change-back")
            forms = _each_once(self._among(every.where("e is not null"), "e", self._ids(theirs, "e"), "left_semi")).unionByName(theirs.where("e is null"))
            add = compose(add.unionByName(patches(self._among(forms, "k", back, "left_semi"), self.kinds)))
            base = self._among(base, "k", back, "left_anti")
        add = stored(add, "change-patches")
        keys = self._ids(add, "k")
        return self._among(base, "k", keys, "left_anti").unionByName(compose(self._among(base, "k", keys, "left_semi").unionByName(add)))


def scratch_table(spark: SparkSession, kinds: Kinds = Kinds(), **columns: str) -> ChangeTable:
    """An empty table in the shared folder."""
    return ChangeTable(spark, scratch(spark, "changes"), kinds, **columns)
