"""What the training-data operators share: tables in, Arrow batches, cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Records of an Arrow batch. Texts are a few kB on average and may be 100 kB and more.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of so many rows at most, so that a batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a folder of this machine, for sessions of one machine only."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="loomlight-")


def materialize(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, with a cut lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    written = df.checkpoint(eager=True)
    # a checkpoint keeps the size and the constraints that were estimated for its plan; over
    # rounds of joins these grow to numbers of thousands of digits, so the rows get a plan of their own
    session = df.sparkSession
    rows = session._jsparkSession.internalCreateDataFrame(written._jdf.queryExecution().toRdd(), written._jdf.schema(), False)
    return DataFrame(rows, session)


#: Rows of a partition of small tables.
PART_ROWS = 100_000


def compact(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows, written, in about as many partitions as they need, and their number.

    A table of links may have a few rows in each of very many partitions; every later shuffle
    would write files for each of them.
    """
    found = materialize(df)
    count = found.count()
    return found.coalesce(max(1, -(-count // PART_ROWS))), count


def trim() -> None:
    """Gives memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of what nothing refers to any more, and frees the driver's own memory."""
    trim()
    spark.sparkContext._jvm.System.gc()


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task; each task asks first, and what others kept there goes back to the system."""
    others = [x for x in _caches if x != owner]
    for other in others:
        del _caches[other]
    if others:
        trim()
    return _caches.setdefault(owner, {})


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases (64 bits) from those of their words but the last, and of the last words."""
    x = (before + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(27))
