"""Shared helpers: scratch tables in the cluster's shared folder, and the word rules of the contracts."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate tables: upper-case ASCII to lower case, and for words of letters,
#: digits and non-ASCII characters every other ASCII byte to a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else (b + 32 if 65 <= b <= 90 else 32)
    for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary
    folder where that is unset and all run on one machine; elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_made: list[tuple[SparkSession, str]] = []
_trimmed = {"at": -1e9}


def trim_driver(spark: SparkSession, every: float = 3.0) -> bool:
    """Has the driver's JVM return the native memory that it freed, unless it did so in the
    last `every` seconds. Compiling and some hundreds of threads use up to eight allocator
    arenas a core, which keep what is freed in them: in a chain of many small actions that
    comes to hundreds of MB. False where it was not done: too soon, no JVM of its own, or
    one without this command."""
    if time.monotonic() - _trimmed["at"] < every:
        return False
    _trimmed["at"] = time.monotonic()
    try:
        jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
        named, beans = jvm.java.lang.Class.forName, jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds, given = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface, as the server's class is closed to calls by reflection
        said = named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, given)
    except Exception:
        _trimmed["at"] = float("inf")  # nor will it be there the next time
        return False
    return "RSS" in str(said)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: lineage ends
    there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the scratch tables made so far (also runs when the process ends)."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its folder belongs to the cluster
            return


atexit.register(release)


def few_driver_threads(spark: SparkSession, most: int = 16) -> None:
    """Holds the driver's pools of shuffle and broadcast threads to `most` each. They begin a
    thread for every exchange, up to 1,024 and 128, and keep each for a minute: a chain of
    many small exchanges takes hundreds of stacks and their allocator arenas. It counts
    before the process's first exchange; later it changes nothing. These are static
    settings, so spark.conf can't be asked; a session without a JVM of its own stays as it is."""
    try:
        conf = spark._jsparkSession.sessionState().conf()
    except AttributeError:
        return
    for pool in ("shuffleExchange", "broadcastExchange"):
        conf.setConfString(f"spark.sql.{pool}.maxThreadThreshold", str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, with the session's Arrow batches held to `rows` rows at most: the rows that go
    to Python from here on are whole texts, and a batch of them lies in memory on both
    sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(docs.sparkSession.conf.get(key))
    if now <= 0 or now > rows:
        docs.sparkSession.conf.set(key, str(rows))
    return docs


def give_back() -> None:
    """Returns what this Python worker no longer needs to the system: workers are reused,
    and what one stage has freed would stay with them through the next."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidy(batches_of):
    """A function of Arrow batches that gives its memory back when its task ends."""

    def run(batches):
        try:
            yield from batches_of(batches)
        finally:
            give_back()

    return run


def held_out(doc_id="doc_id"):
    """True for the rows whose crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """At most n rows, always the same ones: those with the smallest hashes of doc_id."""
    return df.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with _ appended until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def joined_ids(rows: DataFrame, ids: DataFrame, how: str, column: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """rows with (left_semi) or without (left_anti) the ids (one column: distinct, no null).
    Up to `most` ids are broadcast, so the rows stay where they are; more are joined by a
    shuffle. rows may have any other columns."""
    (name,) = free_names(rows, "joined_id")
    ids = stored(ids.toDF(name), "ids")
    small = ids.count() <= most
    return rows.join(F.broadcast(ids) if small else ids, F.col(column) == F.col(name), how)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer on uint64 arrays (wraps on purpose)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
