"""What the operators of this subpackage share: worker set-up, shared tables, hashing of words."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009 to U+000D. `bytes.split()` cuts at exactly these.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Put the repository on the workers' path, and give the context a checkpoint folder.

    The folder is the session's `spark.checkpoint.dir`. Only a single-JVM session without that setting
    (tests) gets a temporary one; on a cluster a machine-local folder would not be shared, so it raises.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(folder)


def shared_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it back: later steps neither recompute it nor
    depend on the executors that made it. `discard` removes it."""
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Remove shared tables that nothing reads any more."""
    for t in tables:
        if t is not None and hasattr(t, "shared_path"):
            jvm, context = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc
            path = jvm.org.apache.hadoop.fs.Path(t.shared_path)
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever extra columns the input brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Equal rows that one task numbers at a time.
NUMBERED = 4096


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Every row, with its number from 0 on among the rows that equal it.

    Equal rows are counted (combined before the shuffle) and made again from the count, many of them in blocks that are dealt anew, so
    that a row that stands for any share of the table is never gathered in one task.
    """
    n, block = fresh(rows, "_n", "_block")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    counted = rows.groupBy(*columns).agg(F.count("*").alias(n))
    single = counted.filter(F.col(n) == 1).select(*columns, F.lit(0).cast("long").alias(name))
    blocks = counted.filter(F.col(n) > 1).select(*columns, n, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {NUMBERED}"))).alias(block))
    several = blocks.repartition(*columns, F.col(block)).select(
        *columns, F.explode(F.sequence(F.col(block) * NUMBERED, F.least(F.col(n), (F.col(block) + 1) * NUMBERED) - 1)).alias(name)
    )
    return single.unionByName(several)


def words_column(text) -> "F.Column":
    """The words of a string column, as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != F.lit(""))


def word_count(text) -> "F.Column":
    """Number of words of a string column; null has none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WORD_SPLIT))).cast("long")


_held: dict[str, Callable[[], None]] = {}
_owner = ""


def release() -> None:
    """On a worker: give memory that is free again back to the system; allocators keep it otherwise, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hold(owner: str, forget: Callable[[], None] | None = None) -> None:
    """On a worker: what other operators remember there is forgotten, so that one operator's memory is held at a time."""
    global _owner
    for name in [n for n in _held if n != owner]:
        _held.pop(name)()
    if forget is not None:
        _held[owner] = forget
    if owner != _owner:
        _owner = owner
        gc.collect()
        release()


def slices(batches, rows: int = 1024):
    """Batches in parts of few rows, so that what is made of a part is small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, on a uint64 array (wraps around)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a = np.zeros(n, np.uint64)
    for j in range(k):
        a = a * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix64(a)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[:-step], a[step:])
        have += step
    return a


def byte_offsets(words: list[bytes]) -> np.ndarray:
    """Start of each word in the words joined by one space, and one past the end (plus that space) at last."""
    out = np.empty(len(words) + 1, np.int64)
    out[0] = 0
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=out[1:])
    return out
