"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many key rows (16 bytes each, 32 MB) may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Bytes of texts that a task's Python takes apart together, a fiftieth to a hundredth of what that needs; bytes that are sent to it at once.
SLICE, SENT = 512 << 10, 2 << 20
#: Bytes of files that a task reads where each row is much work.
FILES = "16m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in tests, a local folder is used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='spark-tidemark-')}"
    return f"{root.rstrip('/')}/tidemark/{uuid.uuid4().hex}"


def written(df: DataFrame, *sort_by: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_FILES = "spark.sql.files.maxPartitionBytes"


def _written_under(df: DataFrame, setting: str, value: str, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(setting)
    try:
        conf.set(setting, value)
        return write(df)
    finally:
        conf.set(setting, before)


def written_and_tidied(df: DataFrame) -> DataFrame:
    """written(df), whose shuffle files go as soon as the table is there; df is not to be run again."""
    return _written_under(df, _CLEANUP, "true", written_by_bytes)


def written_by_bytes(df: DataFrame) -> DataFrame:
    """written(df), whose Arrow functions are sent SENT bytes at a time, so that texts of any length fill neither a task's Python nor the buffers that feed it."""
    return _written_under(df, _BYTES, str(SENT))


def written_by_files(df: DataFrame) -> DataFrame:
    """written_by_bytes(df), which reads files of some FILES bytes in a task each, as their rows are few and much work."""
    return _written_under(df, _FILES, FILES, written_by_bytes)


def written_by_batches(df: DataFrame, rows: int) -> DataFrame:
    """written(df), whose Arrow functions are sent at most so many rows at a time, so that long texts do not fill a task's memory."""
    return _written_under(df, _BATCH, str(rows))


def byte_slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; one text is never split."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at, n = 0, len(texts)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id as text: the split between training and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def smallable(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """keys with a broadcast hint if it has at most ``most`` rows, else unhinted."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in gone(doc_id); a null id stays."""
    ids = written_by_bytes(gone.select("doc_id").filter("doc_id is not null").distinct())
    return docs.join(smallable(ids), "doc_id", "left_anti").select(*docs.columns)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression of weighted rows by Newton's method; the last is the intercept."""
    x, own = np.c_[x, np.ones(len(x))], np.ones(len(x)) if weight is None else weight
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (own * p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (own * (p - y)) + keep @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
