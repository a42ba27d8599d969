"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separator of every operator here: space and \t \n \v \f \r, nothing else.
SEPARATOR = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a Parquet table; the path may be in any store that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests on one machine) gets a folder
    under /tmp; on a cluster, whose executors would not see it, that is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            conf = current.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            conf = "file:///tmp/checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Folders written inside each open ``scratch`` block, innermost last.
_SCRATCH: list[list[str]] = []
#: Rows of an Arrow batch inside ``scratch``: texts are long, and the JVM and the Python worker both hold a batch.
BATCH_ROWS = 2_000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, on leaving the block, what ``cut`` wrote in it; ``cut(df, keep=True)`` results stay, for the enclosing block."""
    _SCRATCH.append([])
    rows = spark.conf.get(_ROWS_CONF)
    spark.conf.set(_ROWS_CONF, str(min(int(rows) if int(rows) > 0 else BATCH_ROWS, BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_CONF, rows)
        for path in _SCRATCH.pop():
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared folder as Parquet and read it back.

    Survives lost executors, and is compressed and columnar, unlike the row
    files of ``checkpoint()``. Inside ``scratch`` it is deleted at the end.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "cut")
    level = len(_SCRATCH) - 1 - keep
    if level >= 0:
        _SCRATCH[level].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """At the end of a task, hands freed memory back to the system: the worker lives on, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run`` for mapInArrow over at most BATCH_ROWS rows at once, whatever the session's batches; its memory is handed back at the end of a task."""

    def tidied(batches):
        yield from run(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS))
        release()

    return tidied


def text_of(column: str = "text"):
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def spare(df: DataFrame, name: str) -> str:
    """``name``, or with underscores appended until no column of ``df`` has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
