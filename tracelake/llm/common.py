"""What the operators share: text batches, tables in the shared folder, and worker-side caches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of them, that a Python worker turns into Python objects at a time; a longer row is one by itself.
ROWS_AT_A_TIME, BYTES_AT_A_TIME = 512, 2 << 20

#: Batches after which a worker gives freed memory back.
BATCHES_TO_RELEASE = 64

#: Values that Python workers keep from task to task, by the key of what made them.
WORKER: dict = {}

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, text) of any table that has them; a null text becomes an empty one, other columns are not read."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset and driver and executors are one process (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="tracelake-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder. Driver and executors all reach it, and a lost executor loses nothing of it."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> Iterator[None]:
    """Batches to Python of at most so many rows, and no more rows once they pass `size` bytes, for what runs within; the session's own settings return."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written as a table in the shared folder and read again, which cuts its lineage."""
    path = scratch(df.sparkSession, tag)
    schema = df.schema
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def parts(b: pa.RecordBatch, rows: int, size: int = BYTES_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """b in pieces of at most `rows` rows and, but for single rows, `size` bytes."""
    if b.num_rows > rows:
        for at in range(0, b.num_rows, rows):
            yield from parts(b.slice(at, rows), rows, size)
    elif b.num_rows > 1 and b.nbytes > size:
        half = b.num_rows // 2
        yield from parts(b.slice(0, half), rows, size)
        yield from parts(b.slice(half), rows, size)
    elif b.num_rows:
        yield b


def release() -> None:
    """Gives memory that this process has freed, Arrow's included, back to the machine, where its C library can; workers live on, and otherwise keep what a stage took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage in full, after which they give the heap they do not need back to the machine: of themselves they keep
    what a stage made them take, beside the Python workers of the next. One small task for each core reaches every executor that is idle. Only a hint: one
    that is missed, or whose JVM ignores it, keeps its heap, and no result depends on it."""
    master = spark.sparkContext.master
    tasks = 1 if master == "local" or master.startswith("local[") else spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def map_arrow(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], rows: int = ROWS_AT_A_TIME) -> DataFrame:
    """mapInArrow with batches of at most `rows` rows and BYTES_AT_A_TIME bytes; make() runs once a task and gives the function for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for k, b in enumerate(batches):
            for part in parts(b, rows):
                if (out := f(part)) is not None:
                    yield out
            if (k + 1) % BATCHES_TO_RELEASE == 0:
                release()
        del f
        release()

    return df.mapInArrow(run, schema)


def map_rows(docs: DataFrame, schema: str, make: Callable[[], Callable[[list[str]], list[pa.Array]]]) -> DataFrame:
    """Whole rows of docs, as the struct `_row`, with columns that make()'s function gives for their texts (null: empty)."""
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"))
    names = ["_row", *(x.split()[0] for x in schema.split(", "))]

    def batches() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        worker_value(("rows",), lambda: None)
        f = make()

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(0).field("text").to_pylist()
            return pa.RecordBatch.from_arrays([b.column(0), *f([t or "" for t in texts])], names)

        return batch

    fields = [*rows.schema.fields, *T.StructType.fromDDL(schema).fields]
    return map_arrow(rows, T.StructType(fields), batches)


def quoted(name: str) -> str:
    """A column's name as it stands, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def worker_value(key: tuple, make: Callable):
    """make()'s value, kept by this worker under the key until another operator wants one of another kind."""
    if key not in WORKER:
        for other in [k for k in WORKER if k[0] != key[0]]:
            del WORKER[other]
        release()
        WORKER[key] = make()
        release()
    return WORKER[key]


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())
