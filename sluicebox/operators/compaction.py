"""Far too many small files: consolidated into a few well-sized ones, no record lost or doubled (problem 2).

Files of newline-delimited records are first joined at byte level (`concatenate`): a body goes into its new file as the
very bytes it is, unparsed, with the line end supplied that its last line may lack; no shuffle, the small files of a
task stand one behind the other. Length, lines and checksum of what came in and of what the new files hold are compared
before the join counts.

Left-over and repeated files hold a record twice, so a second step (`consolidate`) settles the joined lines: the key of
each line is looked at, one line of each key is kept and ordered by time, and it, too, is written as the bytes it was.
What it leaves out is accounted for: all lines that were joined must be those kept, surplus copies and those rejected,
by number, bytes and checksum, and the lines kept must be those of the new files. Checksums are sums over lines, so the
order is free. The writers' own n_rows and n_bytes are no measure, as they are wrong in places; `claims` reports where.

`write_frames` and `join_frames` do the first step for bodies that are complete zstandard frames: joined as they are.

Defined results: null and empty bodies hold nothing; carriage returns and blank lines end with the second step; a line
that isn't a complete JSON object with both keys is set aside (`rejected`), never joined to another; of lines with one
key the one with the earliest received_at counts (none last), then the smaller line; an empty table gives an empty
directory of files.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id, iso_instant
from ..session import remove, stored, write_atomically

#: Bytes of a consolidated file.
TARGET_BYTES = 256 << 20


def lines_of(files: DataFrame, body: str = "body") -> DataFrame:
    """line: each line that isn't blank, without its line end."""
    return files.where(F.col(body) != "").select(F.explode(F.split(F.col(body), r"\r\n|\n|\r")).alias("line")).where(F.trim(F.btrim("line", F.lit(" \t\r\n"))) != "")


def keyed(lines: DataFrame, keys: tuple[str, ...] = ("session", "txid"), time: str = "received_at") -> DataFrame:
    """line, the keys (the last one cleaned as an id), received: null keys where the line isn't a complete record."""
    value = F.try_parse_json("line")
    fields = [F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in keys]
    out = lines.select("line", value.alias("v")).select("line", *fields, iso_instant(F.try_variant_get("v", f"$.{time}", "string")).alias("received"))
    return out.withColumn(keys[-1], clean_id(F.col(keys[-1])))


def _complete(keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull() & (F.col(k) != "")
    return out


def rejected(files: DataFrame, keys: tuple[str, ...] = ("session", "txid"), body: str = "body") -> DataFrame:
    """The lines set aside."""
    return keyed(lines_of(files, body), keys).where(~_complete(keys)).select("line")


@dataclass(frozen=True)
class Totals:
    """What a set of lines amounts to, whatever their order."""

    n_lines: int
    n_bytes: int
    checksum: str

    def __add__(self, other: Totals) -> Totals:
        return Totals(self.n_lines + other.n_lines, self.n_bytes + other.n_bytes, str(int(self.checksum) + int(other.checksum)))


def _measures() -> tuple[Column, Column, Column]:
    """Lines, bytes and checksum of a group of lines."""
    return F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("b"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("c")


def _sums(row) -> Totals:
    return Totals(row.n or 0, row.b or 0, str(row.c or 0))


def totals(lines: DataFrame) -> Totals:
    return _sums(lines.agg(*_measures()).first())


def surplus(held: DataFrame) -> Totals:
    """What the lines that unique_lines left out as further copies amount to."""
    own = F.octet_length("line"), F.xxhash64("line").cast("decimal(38,0)")
    return _sums(held.agg(F.sum(F.col("n") - 1).alias("n"), F.sum(F.col("b") - own[0]).alias("b"), F.sum(F.col("c") - own[1]).alias("c")).first())


def unique_lines(files: DataFrame, keys: tuple[str, ...] = ("session", "txid"), body: str = "body") -> DataFrame:
    """One line of each key, with its key and time, and n, b, c: lines, bytes and checksum of all its copies."""
    rows = keyed(lines_of(files, body), keys).where(_complete(keys))
    pick = F.min(F.struct(F.isnull("received").alias("late"), "received", "line"))
    return rows.groupBy(*keys).agg(pick.alias("m"), *_measures()).select(*keys, "m.received", "m.line", "n", "b", "c")


def _split_at(body: Column, end: str) -> Column:
    """The lines of a body by one kind of line end; the end of the last line starts no further one."""
    whole = F.when(F.endswith(body, F.lit(end)), F.substring(body, F.lit(1), F.length(body) - len(end))).otherwise(body)
    return F.split(whole, end)


def raw_lines(files: DataFrame, body: str = "body") -> DataFrame:
    """line: every line of every body as it stands, blank ones and carriage returns included."""
    return files.where(F.col(body) != "").select(F.explode(_split_at(F.col(body), "\n")).alias("line"))


def concatenate(spark: SparkSession, files: DataFrame, out_dir: str, target_bytes: int = TARGET_BYTES, body: str = "body") -> Totals:
    """Join the bodies, as they are and without a shuffle, to files of about target_bytes in out_dir; the totals of all lines.

    ValueError if the new files don't hold the very lines that came in.
    """
    given = totals(raw_lines(files, body))
    n = max(1, math.ceil((given.n_bytes + given.n_lines) / target_bytes))
    whole = F.col(body)
    bodies = files.where(whole != "").select(F.when(F.endswith(whole, F.lit("\n")), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("body"))
    bodies.coalesce(n).write.text(out_dir)
    held = totals(joined_lines(spark, out_dir))
    if given != held:
        raise ValueError(f"the joined files differ from what went in: {given} and {held}")
    return held


def joined_lines(spark: SparkSession, out_dir: str) -> DataFrame:
    """line: every line of joined files; only line feeds end one."""
    return spark.read.option("lineSep", "\n").schema("line string").text(out_dir)


def claims(files: DataFrame, name: str = "file_path", body: str = "body", rows: str = "n_rows", size: str = "n_bytes") -> DataFrame:
    """name, claimed_rows, held_rows, claimed_bytes, held_bytes of each file whose writer's counts aren't those of its body.

    Rows are lines that aren't blank. Null bodies hold nothing; a null claim differs from any count.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    full = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(" \t\r\n")) != "")
    held = files.select(
        name, F.col(rows).alias("claimed_rows"), F.size(full).cast("bigint").alias("held_rows"), F.col(size).alias("claimed_bytes"), F.octet_length(text).cast("bigint").alias("held_bytes")
    )
    return held.where(~(F.col("claimed_rows").eqNullSafe(F.col("held_rows")) & F.col("claimed_bytes").eqNullSafe(F.col("held_bytes"))))


def consolidate(spark: SparkSession, files: DataFrame, out_dir: str, keys: tuple[str, ...] = ("session", "txid"), target_bytes: int = TARGET_BYTES, body: str = "body") -> Totals:
    """Write the records of `files` to a few files of about target_bytes under out_dir/files, in order of received_at over all files.

    The number of files follows the bytes that came in. A range shuffle orders the records, so files hold disjoint spans
    of time and a hot session or hour spreads over as many as it needs. out_dir/totals.json, written last and only if
    lengths and checksums agree, marks the files as whole; it holds the totals of the lines joined, of those kept, of
    surplus copies and of rejected lines (blank lines count nowhere). What stands between is removed then.
    """
    joined, kept = f"{out_dir}/joined", f"{out_dir}/kept"
    size = concatenate(spark, files, joined, target_bytes, body)
    lines = joined_lines(spark, joined)
    n = max(1, math.ceil((size.n_bytes + size.n_lines) / target_bytes))
    unique = unique_lines(lines, keys, "line")
    unique.write.option("compression", "zstd").parquet(kept)
    held = spark.read.schema(unique.schema).parquet(kept)
    order = ("received", *keys)
    held.repartitionByRange(n, *order).sortWithinPartitions(*order).select("line").write.text(f"{out_dir}/files")
    before, after = totals(held), totals(consolidated_lines(spark, out_dir))
    if before != after:
        raise ValueError(f"consolidated files differ from what went in: {before} and {after}")
    given, copies, aside = totals(lines_of(lines, "line")), surplus(held), totals(rejected(lines, keys, "line"))
    if given != after + copies + aside:
        raise ValueError(f"of the input {given}, {after} were kept, {copies} are surplus copies and {aside} rejected")
    write_atomically(spark, f"{out_dir}/totals.json", json.dumps({"input": asdict(given), "kept": asdict(after), "surplus": asdict(copies), "rejected": asdict(aside)}))
    remove(spark, joined)
    remove(spark, kept)
    return after


def consolidated_lines(spark: SparkSession, out_dir: str) -> DataFrame:
    """line: the records of the consolidated files."""
    return spark.read.text(f"{out_dir}/files").withColumnRenamed("value", "line")


ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def _numbers() -> Iterator[int]:
    """Numbers that no other task gives."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return itertools.count((context.partitionId() if context else 0) << 32)


def join_frames(files: DataFrame, out: str = "file_no", data: str = "data", target_bytes: int = TARGET_BYTES) -> DataFrame:
    """out, data, n_frames, n_bytes, checksum: complete zstandard frames joined as they are into bodies below target_bytes.

    A zstandard file is a row of frames, so joining complete ones needs no unpacking; each is checked for its magic
    number and for completeness by walking its block headers. A broken body raises; an empty or null one is left out.
    Each row has a number of its own, over all tasks.
    """
    import zlib

    def pack(batches):
        import pandas as pd

        parts: list[bytes] = []
        size = frames = 0
        numbers = _numbers()

        def flush():
            nonlocal parts, size, frames
            body = b"".join(parts)
            row = pd.DataFrame({out: [next(numbers)], data: [body], "n_frames": [frames], "n_bytes": [len(body)], "checksum": [zlib.crc32(body)]})
            parts, size, frames = [], 0, 0
            return row

        for pdf in batches:
            for body in pdf[data]:
                if not body:
                    continue
                count = count_frames(bytes(body))
                if parts and size + len(body) > target_bytes:
                    yield flush()
                parts.append(bytes(body))
                size += len(body)
                frames += count
        if parts:
            yield flush()

    return files.select(data).mapInPandas(pack, f"{out} bigint, {data} binary, n_frames bigint, n_bytes bigint, checksum bigint")


def write_frames(files: DataFrame, out_dir: str, data: str = "data", target_bytes: int = TARGET_BYTES) -> DataFrame:
    """path, n_frames, n_bytes, checksum of each file written: frames joined as they are, by a stream, below target_bytes each.

    Every attempt of a task writes under names of its own, and only the rows of the attempt that counts are in the
    table given back, so a lost executor's files are in no list. The table is written before it is returned: what it
    lists is there. A single body above target_bytes gets a file of its own.
    """
    import zlib

    base = out_dir.rstrip("/")

    def write(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(base)
        system.create_dir(folder, recursive=True)
        made, stream, size, frames, check, path = [], None, 0, 0, 0, ""

        def close():
            stream.close()
            made.append((f"{base}/{path}", frames, size, check))

        for pdf in batches:
            for body in pdf[data]:
                if not body:
                    continue
                body = bytes(body)
                count = count_frames(body)
                if stream is not None and size + len(body) > target_bytes:
                    close()
                    stream = None
                if stream is None:
                    path, size, frames, check = f"{uuid.uuid4().hex}.zst", 0, 0, 0
                    stream = system.open_output_stream(f"{folder}/{path}")
                stream.write(body)
                size, frames, check = size + len(body), frames + count, zlib.crc32(body, check)
        if stream is not None:
            close()
        yield pd.DataFrame(made, columns=["path", "n_frames", "n_bytes", "checksum"])

    return stored(files.select(data).mapInPandas(write, "path string, n_frames bigint, n_bytes bigint, checksum bigint"), "frames")


def compressed(files: DataFrame, body: str = "body", data: str = "data") -> DataFrame:
    """data: each body as one complete frame that ends in a line end. Null and empty bodies are left out."""

    def pack(batches):
        import pandas as pd
        import zstandard

        tool = zstandard.ZstdCompressor()
        for pdf in batches:
            yield pd.DataFrame({data: [tool.compress(x.encode() if x.endswith("\n") else f"{x}\n".encode()) for x in pdf[body]]})

    return files.where(F.col(body) != "").select(body).mapInPandas(pack, f"{data} binary")


def frame_totals(spark: SparkSession, written: DataFrame) -> DataFrame:
    """path, n_lines, n_text_bytes of files of frames, unpacked by a stream; ValueError if bytes or checksum aren't those listed."""

    def measure(batches):
        import zlib

        import pandas as pd
        import zstandard
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for path, size, check in zip(pdf["path"], pdf["n_bytes"], pdf["checksum"], strict=True):
                system, name = fs.FileSystem.from_uri(path)
                seen = total = lines = text = 0
                unpack = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
                with system.open_input_stream(name) as stream:
                    while block := stream.read(1 << 20):
                        seen, total = zlib.crc32(block, seen), total + len(block)
                        part = unpack.decompress(block)
                        lines, text = lines + part.count(b"\n"), text + len(part)
                if (total, seen) != (size, check):
                    raise ValueError(f"{path} isn't the file that was written")
                rows.append((path, lines, text))
            yield pd.DataFrame(rows, columns=["path", "n_lines", "n_text_bytes"])

    return written.select("path", "n_bytes", "checksum").mapInPandas(measure, "path string, n_lines bigint, n_text_bytes bigint")


def count_frames(body: bytes) -> int:
    """The number of complete zstandard frames that make up a body; ValueError if it's anything else."""
    at = count = 0
    while at < len(body):
        if len(body) >= at + 8 and 0x50 <= body[at] <= 0x5F and body[at + 1 : at + 4] == b"\x2a\x4d\x18":  # a frame to skip
            at += 8 + int.from_bytes(body[at + 4 : at + 8], "little")
        elif body[at : at + 4] != ZSTD_MAGIC or len(body) < at + 5:
            raise ValueError(f"no zstandard frame at byte {at}")
        else:
            head = body[at + 4]
            single = head >> 5 & 1
            at += 5 + (not single) + (0, 1, 2, 4)[head & 3] + (1 if single else 0, 2, 4, 8)[head >> 6]
            last = False
            while not last:
                if len(body) < at + 3:
                    raise ValueError("a zstandard frame is cut off")
                block = int.from_bytes(body[at : at + 3], "little")
                last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
                at += 3 + (1 if kind == 1 else size)
            at += 4 * (head >> 2 & 1)
        if at > len(body):
            raise ValueError("a zstandard frame is cut off")
        count += 1
    return count
