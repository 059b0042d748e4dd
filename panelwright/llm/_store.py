"""Shared folders, partition counts and Arrow batches for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; long texts make larger batches a memory risk.
BATCH_ROWS = 512
#: Bytes of text that one numpy pass handles; a longer text forms a pass alone.
SLICE_BYTES = 1 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="panelwright-")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps survive lost executors without recomputing it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what ``stored`` has written for ``frames``."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Partitions of explicit exchanges: Spark's own setting, which users size to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_rows(spark: SparkSession) -> None:
    """Keep Arrow batches small; the setting holds for the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns``, so that further columns of any name cannot clash with computed ones."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose texts hold about SLICE_BYTES each."""
    offsets = text_offsets(batch.column(column))
    row, rows = 0, batch.num_rows
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def text_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and the offsets of each in them; a null is empty."""
    offsets = text_offsets(texts)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]
