"""Helpers shared by the training-data operators: the shared folder, written tables, readers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir. Where it is unset, a temporary folder
    takes its place on a local master, as in tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/evidra-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    tidy()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        if "/evidra-" in root:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Rows of fixed width that a join may broadcast.
MOST_BROADCAST = 4_000_000


def bounded(small: DataFrame, rows: int | None = None) -> DataFrame:
    """The side of a join to broadcast if its counted rows are few enough, else to be sorted and merged."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= MOST_BROADCAST else small.hint("merge")


def tidy() -> None:
    """Give a Python process's free memory back: workers wait beside the next ones, the driver's beside its JVM, with what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage and give memory back, before a stage and behind large plans.

    By itself it keeps a heap of three times what lives, and what native code has freed. For this
    collection it may keep half as much again, and on Linux freed native memory goes back too. JVMs
    without these options only collect.
    """
    tidy()
    jvm = spark.sparkContext._jvm
    management = jvm.java.lang.management.ManagementFactory
    ratios, before = ("MinHeapFreeRatio", "MaxHeapFreeRatio"), []
    try:
        options = management.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        before = [(r, options.getVMOption(r).getValue()) for r in ratios]
        for r, value in zip(ratios, ("10", "33")):
            options.setVMOption(r, value)
    except Py4JError:
        pass
    try:
        jvm.System.gc()
    finally:
        for r, value in reversed(before):
            options.setVMOption(r, value)
    with suppress(Py4JError):
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        management.getPlatformMBeanServer().invoke(commands, "systemTrimNativeHeap", None, None)


def settle_executors(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage, as settle() does in the driver's, before a stage whose Python workers need memory.

    A JVM keeps the heap that a stage's garbage took and holds it beside the next stage's workers. One
    small task for each core asks for the collection, so that idle executors get one at least.
    """
    n = spark.sparkContext.defaultParallelism
    asked = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(asked.alias("asked")).write.format("noop").mode("overwrite").save()


def tidied(run):
    """A function of batches that tidies up behind its last one."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Pieces of `flat` one behind the other: piece k has lengths[k] items from starts[k]."""
    n = lengths[which]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + n, n)]
