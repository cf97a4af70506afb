"""Helpers of the operators: the shared folder, written intermediate tables, Arrow mapping.

Intermediate tables are written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``; so a lost executor costs no more than the
tasks it was running, and lineage ends at each table.  Only where that setting
is missing (tests on one machine) a temporary folder is chosen and set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _LOCAL[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` to ``path`` and read it back, which cuts its lineage; at most ``tasks`` tasks write, one file each."""
    (df.coalesce(tasks) if tasks else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def writers(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks write a small table: one for ``each`` rows, and two for a core at least.

    Where the session has more shuffle partitions than that and does not join small
    ones, each partition would make a file, and on a local disk Hadoop starts
    helper processes for each file.
    """
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI, on the driver or in a task."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of files with nothing but projections and filters on it, so that a row's file and place name it."""
    if "_metadata" in df.columns:
        return False
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def numbered(df: DataFrame, folder: str, name: str = "uid") -> DataFrame:
    """``df`` with a column ``name`` that numbers its rows; a row has the same number whenever the result is read.

    In a scan of Parquet files the number is made of the file's place among the
    files and the row's place in the file, so it does not depend on how the scan is
    cut into tasks, which may change when executors come and go.  Any other table
    is written to ``folder`` once with its numbers, and read from there.
    """
    spark = df.sparkSession
    if not _plain_scan(df):
        return stored(df.withColumn(name, F.monotonically_increasing_id()), f"{folder}/numbered")
    path = f"{name}_file"
    files = sorted(r["f"] for r in df.select(F.col("_metadata.file_path").alias("f")).distinct().collect())  # one row per file
    wide = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(name))
    if len(files) < 2:
        return wide.drop(path)
    places = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"{path} string, {name}_place long")
    found = wide.join(F.broadcast(places) if len(files) <= 100_000 else places, path)
    return found.select(*(F.col(f"`{c}`") for c in df.columns), (F.shiftleft(F.col(f"{name}_place"), 36) + F.col(name)).alias(name))


def row_name() -> str:
    """A column name of its own, so that none clashes."""
    return f"__row_{uuid.uuid4().hex[:8]}"


def without(rows: DataFrame, name: str, gone: DataFrame, folder: str) -> DataFrame:
    """``rows`` without those whose number (column ``name``) is in ``gone`` (one column, uid), and without the numbers."""
    gone = stored(gone.select(F.col("uid").alias(name)), folder)
    return rows.join(gone, name, "left_anti").drop(name)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; other columns stay behind."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def small_batches(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut and joined so that each holds about ``size`` bytes; a longer row stands alone."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        step = b.num_rows if b.nbytes <= size else max(1, int(b.num_rows * size / b.nbytes))
        for at in range(0, b.num_rows, step or 1):
            part = b.slice(at, step)
            bytes_now = b.nbytes * part.num_rows // max(b.num_rows, 1)
            if held and total + bytes_now > size:
                yield _joined(held)
                held, total = [], 0
            held.append(part)
            total += bytes_now
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """A worker's one large object, such as an operator's tables, kept from task to task of the operator."""
    only(key)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def only(key: str | None) -> None:
    """Let go what other operators left in this worker, which serves one after another."""
    if any(k != key for k in _HELD):
        for k in [k for k in _HELD if k != key]:
            del _HELD[k]
        release()


def release() -> None:
    """Give memory that is free back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run: Callable, key: str | None = None) -> Callable:
    """``run`` over a task's batches in a worker that holds nothing of other operators (see ``held``); what the task took is given back when it ends."""

    def tidied(batches):
        only(key)
        yield from run(batches)
        release()

    return tidied


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of at most 1000 rows and about 16 MB, unless the session asks for fewer.

    Its defaults, 10,000 rows and 64 MB, are a few hundred MB as Python objects.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(name)
        if not 0 < int(now.removesuffix("b")) <= most:
            spark.conf.set(name, str(most))


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[list, list], dict]], key: str | None = None, size: int = 4 << 20) -> DataFrame:
    """Run ``make()``'s function over (doc_ids, texts) in Arrow batches; null texts arrive as ''.

    ``make`` runs once per task, so tables that it builds live as long as the task.
    The function gives a dict of columns.  ``key`` names what ``make`` holds in the
    worker (see ``held``), ``size`` the bytes of texts that it gets at once.
    """

    def run(batches):
        work = make()
        for b in small_batches(batches, size):
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(work(ids, texts), schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    bounded_batches(df.sparkSession)
    return df.mapInArrow(tidy(run, key), schema)


def filter_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of ``df``, all columns, for whose texts the predicate is true; no shuffle."""

    at = df.columns.index(text_col)

    def run(batches):
        keep = make()
        for b in small_batches(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep(texts), type=pa.bool_()))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), df.schema)
