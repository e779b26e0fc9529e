"""Token-id output in directly addressable codes.

``write`` tokenizes a table's whole texts and writes their ids, in ascending
id order, as segments: each row of the written Parquet table is one
self-contained image (``talweg.llm.dac``) of whole documents with the index of
where each document lies in it. ``read_documents`` opens the images again.

The texts are range-partitioned by document id (the one shuffle) and sorted
within partitions, so a segment never waits for another; where a document
starts among all ids comes from a running sum over partitions, and within one
from what its task had written, not from a sort of all documents in one place. Segments close after ``SEGMENT_IDS`` ids, so a task holds
one segment at a time, whatever the partition's size; a document is never cut.

Nulls: a null text is empty (its ids: the end id); rows with a null id come
first. Repeated ids stay, in the order of their texts. Extra columns are
ignored. An empty table writes no segment and reads as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talweg.llm import common, dac, tokens

SEGMENT_IDS = 250_000
SEGMENT = "part long, before long, n_ids long, doc_ids array<long>, lengths array<long>, image binary"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of ``docs`` as segments under ``path``."""
    tokenizer = tokenizer or tokens.tokenizer_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        encoder = tokens.Encoder.of(tokenizer)
        held: list = []

        def image():
            nonlocal before
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            names = [i for h in held for i in h[0]]
            row = {"part": [part], "before": [before], "n_ids": [len(ids)], "doc_ids": pa.array([names], pa.list_(pa.int64())), "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())), "image": pa.array([dac.encode(ids)], pa.binary())}
            before += len(ids)
            held.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b in tokens.slices(batch.column(1)):
                ids, lengths = encoder.encode(batch.column(1).slice(a, b - a))
                held.append((names[a:b], ids, lengths))
                if sum(len(h[1]) for h in held) >= SEGMENT_IDS:
                    yield image()
        if held:
            yield image()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(segments, SEGMENT).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written images."""
    files = spark.read.schema(SEGMENT).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, lengths = batch.column("doc_ids")[row].values, batch.column("lengths")[row].values.to_numpy()
                reader = dac.Reader(batch.column("image")[row].as_buffer())
                ends = np.cumsum(lengths)
                ids = reader.slice(0, len(reader)).astype("<u4", copy=False)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                first = batch.column("segment_start")[row].as_py()
                yield pa.RecordBatch.from_pydict({"doc_id": names, "start": pa.array(first + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # One row for each partition that write() made: as many as its shuffle has, whatever the data's size.
    placed = files.join(F.broadcast(parts), "part")
    return placed.select("doc_ids", "lengths", "image", (F.col("part_start") + F.col("before")).alias("segment_start")).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` as directly addressable codes, then read the files back."""
    path = common.scratch(spark, "codes")
    write(common.table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
