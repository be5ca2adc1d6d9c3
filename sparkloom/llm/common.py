"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Bits that ``sifted`` broadcasts at most, in numbers of 64, however many keys are wanted.
SIEVE = 1 << 24
#: The share of its largest heap from which on a driver gives memory back, and the least seconds between two times.
GROWN, PAUSE = 0.5, 10.0


#: What modules keep between the tasks of a worker, by owner: how to let it go.
HELD: dict[str, Callable[[], None]] = {}


def lean(owner: str = "") -> None:
    """Make a worker give memory back: it shares its executor with the JVM and other workers.

    What other owners hold is let go. Arrow then allocates from the system,
    and blocks of a megabyte or more are mapped one by one.
    """
    for name, release in HELD.items():
        if name != owner:
            release()
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)
        libc.mallopt(-1, 1 << 20)
        libc.malloc_trim(0)


_relieved = [float("-inf")]


def relieve(spark: SparkSession) -> None:
    """Make a driver whose heap has grown give memory back.

    Left alone, its JVM takes more heap rather than collect what finished
    jobs leave, and keeps native blocks that it has freed. Broadcasts and
    shuffles that nothing refers to any more are let go with it.
    """
    java = spark._jvm.java.lang
    runtime = java.Runtime.getRuntime()
    if runtime.totalMemory() < GROWN * runtime.maxMemory() or time.monotonic() - _relieved[0] < PAUSE:
        return
    gc.collect()
    java.System.gc()
    with contextlib.suppress(Py4JError):  # where the JVM has this command; its server is reached by its public interface only
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        (invoke,) = [m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
        values = spark._sc._gateway.new_array(java.Object, 4)
        values[0], values[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, values)
    _relieved[0] = time.monotonic()


def short_batches(spark: SparkSession) -> None:
    """Keep batches for Python short, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be in any store Spark reads."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only where the session has none (local tests) a temporary one is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        folder = tempfile.mkdtemp(prefix="sparkloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Tables written under the shared folder; reading them back cuts lineage.

    Written files survive the loss of any executor, unlike cached blocks.
    """

    _watched: ClassVar[list[list[Scratch]]] = []

    def __init__(self, spark: SparkSession, name: str):
        short_batches(spark)
        for made in self._watched:
            made.append(self)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        relieve(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    @classmethod
    @contextlib.contextmanager
    def removed(cls) -> Iterator[None]:
        """Remove all folders that are made within, at the end; what is still read must be written elsewhere by then."""
        made: list[Scratch] = []
        cls._watched.append(made)
        try:
            yield
        finally:
            cls._watched.pop()
            for scratch in made:
                scratch.drop()

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folder(self, name: str) -> str:
        """The full URI of a folder for files that tasks write themselves."""
        path, store = self._path(name)
        return store.makeQualified(path).toString()

    def drop(self, *names: str) -> None:
        """Remove tables of these names, or the whole folder."""
        for name in names or ("",):
            path, store = self._path(name)
            store.delete(path, True)

    def keep(self, *names: str) -> None:
        """Remove all tables but these."""
        path, store = self._path("")
        for found in store.listStatus(path):
            if found.getPath().getName() not in names:
                store.delete(found.getPath(), True)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def sifted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(others, some)`` of the rows: no key of ``others`` is wanted; ``some`` are the wanted rows and a few more.

    A bit for the hash of each wanted key is broadcast, so that rows can be
    told apart before anything is shuffled. Which of ``some`` are wanted is
    left to an exact join. Null keys are equal; ``keys`` must have the same
    types on both sides.
    """
    slot = F.xxhash64(*keys).bitwiseAND(F.lit(SIEVE - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bits = wanted.groupBy(F.shiftright(slot, 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    marked = rows.join(F.broadcast(bits), F.shiftright(slot, 6) == F.col("__word"), "left")
    hit = F.coalesce(F.getbit("__bits", slot.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return tuple(marked.where(x).drop("__word", "__bits") for x in (~hit, hit))


class Sheltered:
    """Rows under positional names, so that columns made beside them clash with none."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.inner = {name: f"_{i}_" for i, name in enumerate(self.names)}
        self.df = df.toDF(*self.inner.values())

    def col(self, name: str) -> Column:
        return F.col(self.inner[name])

    def restore(self, df: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
        """The rows' own columns under their own names, some of them new."""
        return df.select(*[(new or {}).get(n, self.col(n)).alias(n) for n in self.names])


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts in ``column`` have at most ``most`` bytes, or that are one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and held + size > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``least`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def map_texts(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[str], tuple]],
    key: str | list[str] = "doc_id",
    text: str = "text",
    owner: str = "",
) -> DataFrame:
    """``(*key, *make()(text))`` for each row; ``make`` runs once per task.

    A null text is the empty text. Batches stream through Arrow, so a worker
    holds one batch at a time. The text may be among the keys.
    """
    keys = [key] if isinstance(key, str) else list(key)
    source = df.select(*keys) if text in keys else df.select(*keys, text)
    place = source.columns.index(text)
    kept = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    out = df.sparkSession.createDataFrame([], f"{kept}, {schema}").schema
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(owner)
        work, n = make(), len(keys)
        for batch in batches:
            if len(batch):
                done = zip(*[work(t or "") for t in batch.column(place).to_pylist()], strict=True)
                made = [pa.array(values, f.type) for values, f in zip(done, list(target)[n:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(target.field(i).type) for i in range(n)), *made], schema=target)

    return source.mapInArrow(run, out)
