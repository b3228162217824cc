"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of every contract of this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that are sent to every executor at most, some tens of MB.
BROADCAST_KEYS = 500_000
#: Of a batch of rows on its way to a Python worker.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches on their way to Python hold 64 MB by default, several times over in the JVM and in a worker; texts need
    no such batches. A setting that is smaller already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; the path may be in any store that Spark reads."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where that is unset (tests on
    one machine) a temporary folder takes its place."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder: computed once, and still there when an executor is lost."""
    shared_dir(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


#: What each operator remembers in a worker: how to drop it.
REMEMBERED: dict[str, Callable[[], object]] = {}
_WORKER = {"owner": "", "columns": 0}


def give_back() -> None:
    """Return freed memory to the system; arrays of a megabyte or more are returned as soon as they are freed."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, else it grows with what is freed
        pa.default_memory_pool().release_unused()
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def begin(owner: str) -> None:
    """A worker, which Spark uses for one stage after the other, turns to this operator: it drops what others remember."""
    if _WORKER["owner"] != owner:
        _WORKER["owner"] = owner
        for name, drop in REMEMBERED.items():
            if name != owner:
                drop()
        give_back()


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of a column, null as empty, a few hundred at a time, so that no batch is in memory as Python strings."""
    for k in range(0, len(column), 500):
        for text in column.slice(k, 500).to_pylist():
            yield text or ""
    _WORKER["columns"] += 1
    if _WORKER["columns"] % 8 == 0:
        give_back()


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def ascii_lower(text: str) -> str:
    """text with A-Z in lower case, other letters as they are."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def narrowed(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """df joined (semi or anti) with keys, one column of at most eight-byte values or short ids. Up to
    ``BROADCAST_KEYS`` of them, counted first, are sent to every executor, so wide rows are not shuffled; more are
    joined by a shuffle."""
    keys = cut(keys.distinct())
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how).select(df.columns)


def default_tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine (driver or executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)
