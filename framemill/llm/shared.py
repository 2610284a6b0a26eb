"""Scratch tables in the folder that the cluster shares.

Every operator that needs an intermediate result twice writes it as a Parquet
table under ``spark.checkpoint.dir`` and reads it back, which also cuts lineage:
a lost executor costs a re-read, not a recomputation.  The folder is read from
the session; only where it is unset and executors share the driver's disk (tests,
a laptop) one is chosen here.  The tables of an application lie in one folder,
which goes when Python ends; ``clear`` deletes it sooner.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contract: maximal runs without the six ASCII white-space bytes.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a temporary one if unset."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = f"file://{tempfile.mkdtemp(prefix='framemill-')}"
        spark.conf.set("spark.checkpoint.dir", got)
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


_FOLDERS: set[tuple[str, str]] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/framemill/{app}"
    if (app, folder) not in _FOLDERS:
        if not _FOLDERS:
            atexit.register(_clear_at_exit)
        _FOLDERS.add((app, folder))
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of the application; results that were not written need them."""
    for app, folder in [*_FOLDERS]:
        if app == spark.sparkContext.applicationId:
            forget(spark, folder)
            _FOLDERS.discard((app, folder))


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the context may be on its way out
            clear(spark)


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder; returns what is read back and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def spread(spark: SparkSession) -> int:
    """Partitions to ask for when rows are dealt out: what the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="framemill-")) / "framemill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results have been written; it does so when their objects are collected.

    What the driver's JVM has freed outside its heap goes back to the system too, where the
    JVM offers that: planning and compiling on many threads leaves some 100 MB to malloc.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # HotSpot on Linux has it from 17.0.9 on
        trim_native(spark)


def trim_native(spark: SparkSession) -> str:
    """Have the driver's JVM return what malloc holds of freed memory; what the JVM says to that."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # Py4J finds no methods of a class that its module keeps to itself; those of the interface serve.
    (invoke,) = (m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    return invoke.invoke(beans, given)


#: Parts that the rows of one key are dealt into.
SALTS = 64


def least_by(df: DataFrame, key: str, value: str, name: str, salt: str, pick: Callable[[str], Column] = F.min) -> DataFrame:
    """df with ``name``: the smallest value of each key, or what pick takes.

    A window over the key would bring all its rows to one task.  Here rows are
    reduced per (key, salt), a key's at most SALTS results per key, and the result
    goes back the same way.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    part = salted.groupBy(key, "_salt").agg(pick(value).alias("_m"))
    low = part.groupBy(key).agg(pick("_m").alias(name))
    return salted.join(part.select(key, "_salt").join(low.hint("merge"), key).hint("merge"), [key, "_salt"]).drop("_salt")


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of docs, and ``_row``, a struct of the others: whatever those are called, they meet no other name."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*[F.col(f"`{n}`") for n in names], F.struct(*(rest or [F.lit(0).alias("none")])).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str], *names: str, **new: Column) -> DataFrame:
    """The columns that packed was given with names; new holds what takes their place."""
    own = {n: F.col(f"`{n}`") for n in names} | new
    return rows.select(*[(own[c] if c in own else F.col("_row").getField(c)).alias(c) for c in columns])
