"""Session helpers: defaults for tests, and the shared folder that all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine relies on (UTC, AQE, dynamic partition overwrite)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sluicebox")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the cluster in spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR, None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SHARED_DIR} to a folder that every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="sluicebox-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    if not spark.conf.get(SHARED_DIR, None):
        spark.conf.set(SHARED_DIR, base)
    return base.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; two calls never give the same one. `clear_scratch` removes them all."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove every scratch path this process made; results that read them must have been used by then. Their number."""
    done = len(_MADE)
    while _MADE:
        remove(spark, _MADE.pop())
    return done


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a written table in the shared folder: it outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables of `stored` that nothing reads any more."""
    for t in tables:
        if t._written_to in _MADE:
            _MADE.remove(t._written_to)
        remove(t.sparkSession, t._written_to)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """A scan spread over all cores before work that is heavy for each row, where its files make too few tasks for that.

    A scan that has enough tasks of its own (any large table) is left alone, so nothing is shuffled at scale. Meant for
    scans: the number of partitions of a plan with shuffles is known only by running it.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API, for the few operations that Spark's writers lack."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_atomically(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is either absent or whole: written beside its place, then moved there.

    FileExistsError if the place is taken, also by another writer at that moment: a hard link on a local file system
    and a rename without overwriting elsewhere both fail then. (Object stores without such a rename need one writer.)
    """
    fs, target = hadoop_path(spark, path)
    _, draft = hadoop_path(spark, f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            hadoop = spark._jvm.org.apache.hadoop.fs
            no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, no_options)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from e
        raise
    finally:
        fs.delete(draft, False)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, hidden ones left out; none if there is no such folder."""
    fs, p = hadoop_path(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if n[0] not in "._")


def remove(spark: SparkSession, path: str) -> None:
    """A folder or file gone, whether or not it was there."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small control file."""
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
