"""Helpers shared by the operators that run over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch. Texts reach 100 KB, so Spark's default of 10,000 rows could need a gigabyte in one batch.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts (a session setting, read when the query runs)."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(df: DataFrame, columns: list[str], work: Callable[..., dict], schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns only: ``work(*columns)`` gets the last one as a Python list and the others as Arrow arrays, and returns
    a dict of lists or arrays by the names of ``schema``. Other columns never leave the JVM."""
    bounded_batches(df.sparkSession)
    kinds = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *kept, last = batch.columns
                yield record_batch(work(*kept, last.to_pylist()), kinds)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def record_batch(out: dict, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in kinds], schema=kinds)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    The folder is shared on a cluster, so the rows survive the loss of any executor. Where the setting is absent
    (tests in local mode) a temporary folder is set once for the session.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that are put together inside go as soon as such a query ends. Otherwise they stay until the driver's garbage collector finds that nothing names them, and a driver with
    little to do hardly ever looks: a loop of many small queries then leaves all its files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def refuse_names(keep: tuple[str, ...], own: set[str]) -> None:
    """Columns to keep must not have names that the operator gives to its own columns."""
    if clash := {c.lower() for c in keep} & {c.lower() for c in own}:
        raise ValueError(f"columns to keep have names of the operator's own: {sorted(clash)}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, for tables that all executors read; a temporary one in local mode without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="tarn-shared-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]
