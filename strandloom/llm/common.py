"""Shared helpers: scratch tables in the shared folder and connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.worker import give_back


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A session in one process that names none (tests) gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_made: dict[str, SparkSession] = {}
_own = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver's Python ends if ``sweep`` has not done so before."""
    if not _made:
        atexit.register(_forget_all)
    path = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    for paths in getattr(_own, "open", ()):
        paths.add(path)
    return path


@contextmanager
def scratch_of_thread() -> Iterator[set[str]]:
    """The paths that ``scratch_path`` gives this thread meanwhile; other threads' tables are none of them."""
    paths: set[str] = set()
    _own.open = [*getattr(_own, "open", ()), paths]
    try:
        yield paths
    finally:
        _own.open = [p for p in _own.open if p is not paths]


def scratch_paths() -> set[str]:
    return set(_made)


def sweep(spark: SparkSession, keep: set[str]) -> None:
    """Remove what ``scratch_path`` gave out but ``keep``; for callers who have written what was made of it."""
    for path in scratch_paths() - keep:
        if _made[path] is spark:
            remove_path(spark, path)


def _forget_all() -> None:
    for path, spark in list(_made.items()):
        _forget(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        return


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


#: With this, Spark removes the shuffle files of an execution when it is over.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROWS_A_FILE = 100_000


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation.

    Nothing reads the shuffles of the written plan again, so they go when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    relieve_driver(spark)
    return spark.read.schema(df.schema).parquet(path), path


#: The driver is relieved again after so many seconds, or so many times as long as it took, whichever is more.
REST_S, REST_X = 5, 20
_relieved_until = 0.0


def relieve_driver(spark: SparkSession) -> None:
    """What plans that are over have left in the driver goes back to the system, now and then.

    A loop over tables leaves plans, broadcasts and the free pages of some hundred short-lived threads; its JVM would let its heap
    and its C library's arenas grow to their limits before it gives any back. Broadcasts go from the executors too, once they are garbage here.
    """
    global _relieved_until
    began = time.monotonic()
    if began < _relieved_until:
        return
    spark._jvm.java.lang.System.gc()
    _trim_jvm(spark)
    give_back()
    now = time.monotonic()
    _relieved_until = now + max(REST_S, REST_X * (now - began))


def _trim_jvm(spark: SparkSession) -> str:
    """What the JVM's C library says of the free pages it gave back; empty if this JVM has no such command."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # the server's class is hidden, so its method is taken from the interface
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args) or ""
    except Py4JError:
        return ""


def fewer_files(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, of a few numbers a row and just dealt out by a shuffle, in fewer partitions, so that writing it makes fewer files.

    With ``rows``, the most it can have, it is a partition for each ``ROWS_A_FILE``; else one for eight shuffle partitions, but as many as there are cores.
    On a local file system each new file costs a process (Hadoop's chmod).
    """
    if rows is not None:
        return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst) longs -> (node, component): the smallest node reachable, for every node that has an edge.

    Alternates the large-star and small-star steps, each of which is a minimum per node (combined on
    the map side) and a join that adaptive execution may split; the number of rounds grows with the
    logarithm of the longest path. Self loops are ignored, duplicate edges collapse. Nothing but one
    row of counts per round reaches the driver.
    """
    spark = edges.sparkSession
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e, path = write_table(fewer_files(e), "edges")
    seen = _print(e)
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # neither step makes more edges than it gets
        nxt, nxt_path = write_table(fewer_files(small.union(low.select("u", F.col("m").alias("v"))).distinct(), seen[0]), "edges")
        now = _print(nxt)
        remove_path(spark, path)
        e, path = nxt, nxt_path
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _print(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(r)
