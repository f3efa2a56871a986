"""Token-ID output: whole texts as lists of ids in Parquet, ordered by document.

File format: one row for each document, in ascending doc_id order (null ids first; equal ids keep an order
that is the same in the files and in `start`). Columns: doc_id, shard (number of the file's key range), row
(place in the shard), n_tokens, shard_start (ids of the shard before the document), tokens (list of int).
`tokens` is dictionary-encoded, the ascending metadata columns are delta-encoded (format version 2); row
groups and pages are small and carry column and offset indexes, so that reading a few documents, or the
metadata alone, touches few pages.

Null text counts as empty: a document of the end id alone. An empty table gives an empty table. Repeated
rows are repeated in the files. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import as_strings, new_path, release_memory, small_batches
from basalt.llm.tokenizing import encoder

SCHEMA = "doc_id long, shard int, row long, n_tokens long, shard_start long, tokens array<int>"
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 128 << 10


def _encoded(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in small_batches(batches, 1, 4 << 20):
            ids, counts = encoder(tokenizer).encode(as_strings(batch.column(1)))
            ends = np.cumsum(counts)
            ids, counts = np.insert(ids, ends, end_id), counts + 1
            ends = np.cumsum(counts)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(n, shard, np.int32)),
                    pa.array(np.arange(row, row + n, dtype=np.int64)),
                    pa.array(counts.astype(np.int64)),
                    pa.array(start + ends - counts),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                names=["doc_id", "shard", "row", "n_tokens", "shard_start", "tokens"],
            )
            row, start = row + n, start + int(ends[-1])
        release_memory()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them to path in the format above."""
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        ranged.mapInArrow(_encoded(tokenizer, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with `start`: the ids of all documents before it. Columns not selected are not read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.alias("t").select("shard", (F.expr("sum(total) OVER (ORDER BY shard)") - F.col("total")).alias("shard_base"))
    # one row for each shard, so small enough to send to all
    return rows.join(F.broadcast(before), "shard").withColumn("start", F.col("shard_base") + F.col("shard_start"))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Selected documents: the filter reaches the scan, which skips row groups and pages by their indexes."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "tokens")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(np.array(crcs, np.int64))],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers, of rows of read_tokens()."""
    return tokens.select("doc_id", "start", "tokens").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids in the shared folder, read the files back and digest them."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return digest(read_tokens(spark, path))
