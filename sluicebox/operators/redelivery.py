"""Messages delivered more than once: exactly one row of each identifier is kept, across batches (problem 4).

A store is a set of partitions (by day of receipt, say), an index that says for each identifier which partition holds
its row, and numbered manifests that name the files of both. A batch is merged in four steps: look up in the index which
historical partitions hold an identifier of the batch; read those partitions only and put the batch beside them;
recompute the single winner of each identifier; write the partitions so changed into a folder of their own and publish
the next manifest. Every merge writes under names that nobody used before, and a manifest can be published once only.
So a reader sees the store before or after a batch, never between; a batch that dies half-way leaves files that no
manifest names, now or later (`vacuum` removes them); of two writers at once the second gets FileExistsError and merges
again on what the first left.

The index lies in buckets of the identifiers' hashes, in runs: a merge adds the identifiers that are new or have moved
as one run, a lookup reads the buckets that its batch falls into, and many runs are joined to one. What a moved
identifier leaves behind in the index only makes a later lookup name a partition too many.

The winner is the least row by `order`, and partial aggregation picks it before the shuffle, so an identifier delivered
a million times is one row per task in the shuffle. Partitions are rewritten by a rebalancing shuffle, which splits
large ones and joins small ones.

Defined results: rows with a null or blank identifier are no deliveries of anything; `unidentified` returns them. Equal
rows count as deliveries, too (n_rows). An empty batch changes nothing. Payload columns may have any names and any types
that have an order: they travel in one struct.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import clean_name
from ..session import hadoop_path, names_in, read_small, remove, write_atomically

#: The partition of rows whose partition value is null.
NO_PARTITION = "none"


@dataclass(frozen=True)
class Feed:
    """How the deliveries of a feed are identified, ordered (ascending, nulls encoded) and partitioned."""

    item: str
    order: tuple[Column, ...]
    partition: Column
    payload: tuple[str, ...] = ()

    def rows(self, df: DataFrame) -> DataFrame:
        order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])
        payload = F.struct(*[F.col(f"`{c}`") for c in self.payload]) if self.payload else F.struct(F.lit(True).alias("row"))
        return df.select(
            clean_name(F.col(f"`{self.item}`")).alias("item_id"),
            F.coalesce(F.nullif(self.partition.cast("string"), F.lit("")), F.lit(NO_PARTITION)).alias("part"),
            order.alias("ord"),
            payload.alias("payload"),
        )

    def unidentified(self, df: DataFrame) -> DataFrame:
        """The rows that can't be deduplicated, as they came."""
        return df.where(clean_name(F.col(f"`{self.item}`")).isNull())


#: Buckets of the index, and the runs it may have before they are joined.
BUCKETS = 32
RUNS = 8

_INDEX = "h bigint, part string, run string, bucket int"


class DeliveryStore:
    """One row per identifier, merged batch by batch. root: a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str, feed: Feed):
        self.spark, self.root, self.feed = spark, root.rstrip("/"), feed
        self.version = -1
        self.parts: dict[str, str] = {}
        self.runs: dict[str, list[int]] = {}
        self.schema: T.StructType | None = None
        numbers = [int(n.split(".")[0]) for n in names_in(spark, f"{self.root}/manifests")]
        if numbers:
            self._take(max(numbers), json.loads(read_small(spark, f"{self.root}/manifests/{max(numbers)}.json")))

    def _take(self, version: int, manifest: dict) -> None:
        self.version, self.parts, self.runs = version, manifest["parts"], manifest["index"]
        self.schema = T.StructType.fromJson(manifest["schema"])

    def _data(self, folders: list[str], schema: T.StructType) -> DataFrame:
        """Rows of the named folders, in one scan however many merges wrote them."""
        full = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
        paths = [f"{self.root}/data/{f}" for f in folders]
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*paths).select(*schema.names)

    def winners(self) -> DataFrame | None:
        """item_id, ord, payload, n_rows, part: the table as the manifest has it; None before any batch."""
        return self._data(list(self.parts.values()), self.schema).drop("fresh") if self.parts else None

    def rows(self) -> DataFrame | None:
        """The kept rows in the columns of the feed's payload."""
        held = self.winners()
        return None if held is None else held.select("payload.*")

    def _index(self, runs: dict[str, list[int]]) -> DataFrame | None:
        """h, part, bucket of some buckets of some runs."""
        paths = [f"{self.root}/index/run={r}/bucket={b}" for r, buckets in runs.items() for b in buckets]
        return self.spark.read.schema(_INDEX).option("basePath", f"{self.root}/index").parquet(*paths).select("h", "part", "bucket") if paths else None

    def affected(self, batch: DataFrame) -> list[str]:
        """Partitions that hold an identifier of the batch, by the index, and those its rows belong to."""
        hashed = batch.select("part", _hash().alias("h"), _bucket(_hash()).alias("bucket"))
        # As many values as there are partitions and buckets, whatever the number of rows.
        own = hashed.agg(F.collect_set("part").alias("parts"), F.collect_set("bucket").alias("buckets")).first()
        found = set(own.parts)
        index = self._index({r: [b for b in buckets if b in own.buckets] for r, buckets in self.runs.items()})
        if index is not None:
            held = index.join(hashed.select("h").distinct(), "h", "left_semi").select("part").distinct()
            found |= {r.part for r in held.collect() if r.part in self.parts}
        return sorted(found)

    def merge(self, df: DataFrame) -> list[str]:
        """Apply one batch; returns the partitions rewritten."""
        batch = self.feed.rows(df).where("item_id is not null")
        parts = self.affected(batch) if self.parts else []
        both = batch.withColumn("n_rows", F.lit(1).cast("bigint")).withColumn("fresh", F.lit(True))
        if history := [self.parts[p] for p in parts if p in self.parts]:
            both = both.unionByName(self._data(history, self.schema).withColumn("fresh", F.lit(False)).select(*both.columns))
        won = (
            both.groupBy("item_id")
            .agg(F.min(F.struct("ord", "part", "payload", "fresh")).alias("w"), F.sum("n_rows").alias("n_rows"))
            .select("item_id", "w.ord", "w.payload", "n_rows", "w.fresh", "w.part")
        )
        # Folders of this merge alone, so what they hold once a write has been committed is what that write gave.
        name = uuid.uuid4().hex
        won.hint("rebalance", "part").write.option("compression", "zstd").partitionBy("part").parquet(f"{self.root}/data/version={name}")
        written = {unquote(n.split("=", 1)[1]): f"version={name}/{n}" for n in names_in(self.spark, f"{self.root}/data/version={name}")}
        if not written:
            return []
        changed = self._data(list(written.values()), won.schema).where("fresh")
        runs = self.runs | self._add_run(changed.select(_hash().alias("h"), "part"))
        if len(runs) > RUNS:
            runs = self._add_run(self._index(runs).select("h", "part").distinct())
        manifest = {"parts": {p: v for p, v in self.parts.items() if p not in parts} | written, "index": runs, "schema": won.schema.jsonValue()}
        write_atomically(self.spark, f"{self.root}/manifests/{self.version + 1}.json", json.dumps(manifest))
        self._take(self.version + 1, manifest)
        return sorted({*parts, *written})

    def _add_run(self, entries: DataFrame) -> dict[str, list[int]]:
        run = uuid.uuid4().hex
        path = f"{self.root}/index/run={run}"
        entries.withColumn("bucket", _bucket(F.col("h"))).hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        return {run: sorted(int(n.split("=")[1]) for n in names_in(self.spark, path))}

    def vacuum(self, older_than: float = 86_400.0) -> list[str]:
        """Remove what the newest manifest doesn't name, if nobody has written there for so many seconds; what was removed.

        Readers of older manifests and merges under way need that time.
        """
        named = {f"data/{f.split('/')[0]}" for f in self.parts.values()} | {f"index/run={r}" for r in self.runs}
        gone = []
        for kind in ("data", "index"):
            for folder in names_in(self.spark, f"{self.root}/{kind}"):
                fs, p = hadoop_path(self.spark, f"{self.root}/{kind}/{folder}")
                if f"{kind}/{folder}" not in named and fs.getFileStatus(p).getModificationTime() / 1000 <= time.time() - older_than:
                    remove(self.spark, f"{self.root}/{kind}/{folder}")
                    gone.append(f"{kind}/{folder}")
        return gone


def _hash() -> Column:
    return F.xxhash64("item_id")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")
