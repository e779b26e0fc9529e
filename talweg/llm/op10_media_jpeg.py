"""Media columns: bytes kept losslessly in progressive JPEG files, and files to RGB tensors.

The quantised coefficient is the one unit that a JPEG file keeps exactly, so
``pack`` stores one byte in each AC coefficient (``COEFFICIENT``) of a
three-component image with subsampled chroma, in a file with Huffman tables of its
own; ``unpack`` takes the bytes from the coefficients that the stored file's scans
were read into. ``tensors`` decodes a column of progressive JPEG files of any origin
into full-resolution RGB.

``store`` writes the files as a media column of a Parquet table; ``digest`` is a
second job that reads the table and returns each file's RGB tensor beside what is
worked out from it. Nothing is shuffled and no file waits for
another; a task holds one Arrow slice of files.

Nulls: a null text or file is empty, a null file decodes to a null tensor, and
so does one that is no progressive JPEG. Equal texts give equal values whatever
batch they come in. Repeated rows stay; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from talweg.llm import common, jpeg, tokens

#: Bytes of texts that are coded and of files that are read together (one at least): few enough for the arrays to stay in a processor's cache.
TOGETHER, FILES = 1 << 15, 1 << 14
#: Payloads are filled up with bytes 255 to a multiple of this.
UNIT = 576
#: MCUs in a row of the image, where it has enough; coefficients a block that carry a byte.
ACROSS, CARRY = 16, 63
#: Bytes by their coefficient's size, then all others in turn: what fills up is 0, frequent letters are small. Only ends of
#: sentences and lines are of size 1, which a refinement brings as new coefficients.
FREQUENT, ENDS = b"\xff" + b" ena" + b"irtsolud" + b"cmphgfbyv,kwq-xj", b".\n"
COEFFICIENT = np.zeros(256, np.int16)
COEFFICIENT[[*ENDS, *FREQUENT, *(b for b in range(256) if b not in FREQUENT + ENDS)]] = [1, -1, 0, *(x for k in range(2, 128) for x in (k, -k)), 128]
BYTE = np.zeros(257, np.uint8)
BYTE[COEFFICIENT + 128] = np.arange(256)
SAMPLING = [(2, 2), (1, 1), (1, 1)]
STORED = "doc_id long, n_bytes long, media binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def pack(data: bytes) -> bytes:
    """A progressive JPEG file whose coefficients are ``data``."""
    return jpeg.encode_many([image_of(data)], SAMPLING)[0]


def image_of(data: bytes) -> tuple[list[np.ndarray], int, int, bytes]:
    """(planes, width, height, comment) of the image that holds ``data``."""
    units = max(1, -(-len(data) // (CARRY * 6)))
    down = -(-units // max(ACROSS, -(-units // 4000)))
    across = -(-units // down)
    units = across * down
    value = np.zeros(units * 6 * CARRY, np.int16)
    value[: len(data)] = COEFFICIENT[np.frombuffer(data, np.uint8)]
    blocks = np.zeros((units * 6, 64), np.int16)
    blocks[:, 1:] = value.reshape(-1, CARRY)
    planes = [blocks[: 4 * units].reshape(2 * down, 2 * across, 64), blocks[4 * units : 5 * units].reshape(down, across, 64), blocks[5 * units :].reshape(down, across, 64)]
    return planes, 16 * across, 16 * down, struct.pack(">Q", len(data))


def unpack(image: jpeg.Image) -> bytes:
    """The bytes that ``pack`` stored."""
    value = np.concatenate([p.blocks[:, 1:].ravel() for p in image.components])
    return BYTE[value[: struct.unpack(">Q", image.comment)[0]] + 128].tobytes()


def feature(rgb: np.ndarray) -> str:
    """Height, width, each channel's mean in thousandths, and the share of clipped samples in thousandths, all whole numbers."""
    n = rgb.shape[0] * rgb.shape[1]
    means = [int(x) * 1000 // n for x in rgb.reshape(rgb.shape[0], -1).sum(0, dtype=np.uint32).reshape(-1, 3).sum(0, dtype=np.int64)]
    clipped = int(np.count_nonzero(rgb == 0) + np.count_nonzero(rgb == 255)) * 1000 // (3 * n)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{','.join(map(str, means))}:{clipped}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media (a progressive JPEG file that holds its payload)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column(1), TOGETHER):
                raw = [(t or "").encode() for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(map(len, raw), pa.int64()), pa.array(jpeg.encode_many([image_of(payload(x)) for x in raw], SAMPLING), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(packed, STORED)


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the media column of ``docs`` under ``path``; the table as it is read from there."""
    media_column(docs, id_col, text_col).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(STORED).parquet(path)


def digest(media: DataFrame) -> DataFrame:
    """Decode each stored file into its bytes and its RGB tensor (row-major bytes), with digests of both (``RESULT``)."""
    schema = media.sparkSession.createDataFrame([], RESULT).schema
    kinds = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.slices(batch.column(2), FILES):
                rows = []
                files = batch.column(2).slice(a, b - a).to_pylist()
                for name, size, file, image in zip(names[a:b], sizes[a:b], files, jpeg.decode_many(files)):
                    back, rgb = unpack(image), jpeg.to_rgb(image)
                    rows.append((name, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(rgb), *rgb.shape[:2], rgb.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.types)], schema=kinds)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def tensors(media: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with height, width and the RGB tensor (row-major bytes) of each file."""
    from pyspark.sql.types import BinaryType, IntegerType, StructType

    schema = StructType([*media.select(*keep).schema.fields]).add("height", IntegerType()).add("width", IntegerType()).add("rgb", BinaryType())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(batch.num_columns - 1)
            # A decoded image is far larger than its file: a row at a time leaves this task.
            for k in range(batch.num_rows):
                try:
                    rgb = jpeg.to_rgb(jpeg.decode(files[k].as_py() or b""))
                    row = [[rgb.shape[0]], [rgb.shape[1]], [rgb.tobytes()]]
                except (ValueError, IndexError, KeyError, struct.error):
                    row = [[None]] * 3
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in keep), pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.binary())], names=[*keep, "height", "width", "rgb"])

    return media.select(*keep, media[media_col].alias("_media")).mapInArrow(decoded, schema)


def op10_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as a progressive JPEG, read it back and digest it."""
    return digest(store(common.table(spark, sf_dir, "documents"), common.scratch(spark, "media")))
