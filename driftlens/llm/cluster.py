"""What the operators need from the cluster: the shared folder, code on the workers, batch sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import release

#: Rows of a batch handed to Python. Texts reach several megabytes, so batches are short.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ships this package to the workers once for each context, bounds Arrow batches and sets the checkpoint folder."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)
    if getattr(sc, "_driftlens_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp()) / f"driftlens-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "driftlens").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))  # executors fetch it from Spark's file server
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    sc._driftlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_driftlens_dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        named = sc._driftlens_dir = tempfile.mkdtemp(prefix="driftlens-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/driftlens/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    return path


def mounted(uri: str) -> str:
    """The file-system path of a shared folder that every machine mounts; memory maps need one."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {uri}")
    return u.path


def remove(path: str) -> None:
    """Clears a mounted scratch folder; elsewhere the store's own expiry does."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        shutil.rmtree(u.path, ignore_errors=True)


def spare(spark: SparkSession) -> str:
    """Returns memory that the driver has freed to the system: what its JVM says of it, empty if that JVM can't.

    Compiling plans leaves hundreds of MB in malloc's arenas of the JVM's many threads, beside its heap.
    """
    release()
    java, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:  # py4j sees no methods of the server's own class, which isn't public
        call = next(m for m in java.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = new(java.java.lang.Object, 4)
        args[0], args[1] = java.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(call.invoke(java.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    except Py4JError:
        return ""


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    spare(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each up to which a table is sent to every task; some 40 MB with all overheads.
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """df, a stored table of a few numbers a row, marked for broadcast if it has SMALL_ROWS rows at most; else it is shuffled."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimate(df: DataFrame) -> int:
    """The plan's estimate of df's bytes, 0 if there is none."""
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if told >= 1 << 60 else told


def shards(df: DataFrame, least: int, size: int) -> int:
    """A power of two: least, the shuffle partitions or the plan's estimate of df's bytes over size, whichever is most."""
    return 1 << (max(least, partitions(df.sparkSession), -(-estimate(df) // size)) - 1).bit_length()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atomic_write(path: str, data: bytes | memoryview) -> None:
    """A repeated or speculative task writes the same bytes; the last rename wins."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        f.write(data)
    os.replace(tmp, path)
