"""Helpers shared by the training-text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a default for sessions on one machine that set none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or "/tmp/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") == work_dir(spark).split(":", 1)[-1].lstrip("/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id as text (null: of the empty string)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.asarray(keep.to_numpy(zero_copy_only=False), dtype=bool)
    if not kept.all():
        ends = np.concatenate([[0], np.cumsum(kept)])
        flat, offsets = flat.filter(keep), ends[offsets]
    return flat, np.diff(offsets)


def small_batches(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about most_bytes of text at most (always one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.cumsum(sizes) // most_bytes
        starts = np.concatenate([[0], np.flatnonzero(np.diff(cut)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    small = total < 1 << 31 and (not len(starts) or int(starts.max()) + total < 1 << 31)
    kind = np.int32 if small else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def release_memory() -> None:
    """Give a worker's freed memory back, so that idle workers stay small."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def record_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def blobs(bucket: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """One row for each bucket, with the bytes of its part of each column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(bucket))[: len(first)]
    rows = {"bucket": pa.array(bucket[first].astype(np.int32))}
    for name, values in columns.items():
        values = values[order]
        rows[name] = pa.array([values[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())
    return rows


def gathered(batches: Iterator[pa.RecordBatch], **kinds: str) -> list[np.ndarray]:
    parts: dict[str, list] = {name: [np.zeros(0, kind)] for name, kind in kinds.items()}
    for batch in batches:
        for name, kind in kinds.items():
            parts[name] += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
    return [np.concatenate(parts[name]) for name in kinds]
