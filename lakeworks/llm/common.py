"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

WHITE = " \t\n\x0b\x0c\r"  # what separates words; bytes.split() cuts at the same six characters
BLOCK_BYTES = 4 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a Parquet table in the shared folder and read again.

    It cuts the lineage where a result is used more than once: a lost executor costs a read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_and_texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so extra columns of any name cannot clash."""
    return docs.select("doc_id", "text", *more)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        start, held = 0, 0
        for i, n in enumerate(lengths.to_pylist()):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def held_out(remainder: int, of: int) -> Column:
    """True where crc32 of doc_id as text leaves ``remainder``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == remainder


def one_each(docs: DataFrame, picked: DataFrame, *more: str) -> DataFrame:
    """One row per id of a bounded sample: doc_id, label, text and ``more``, of the smallest hash of the text.

    Copies of a row, however many, are set aside before anything is counted, sent or collected.
    """
    rows = docs.select("doc_id", "text", *more).join(F.broadcast(picked), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text"), *more)).alias("row")
    return rows.groupBy("doc_id", "label").agg(first).select("doc_id", "label", *(F.col("row")[c].alias(c) for c in ("text", *more)))


def lower_hex(digests: Sequence[bytes]) -> list[str]:
    return [x.hex() for x in digests]


def free_name(df: DataFrame, base: str) -> str:
    """A column name the table does not have in any spelling."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = "_" + name
    return name
