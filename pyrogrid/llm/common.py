"""What the text operators share: input shape, batches of bounded size, held-out rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.session import configure

# Rows handed to a Python worker at once; texts of 100 KB then stay below 64 MB.
ARROW_ROWS = 512
# Code points that the vectorised scorers look at in one step.
BLOCK_CHARS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text); a null text counts as empty and other columns play no part."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_name(wanted: str, *taken: list[str]) -> str:
    """``wanted``, or its first numbered form that no listed name equals in any case."""
    used = {name.lower() for names in taken for name in names}
    name, k = wanted, 0
    while name.lower() in used:
        k += 1
        name = f"{wanted}_{k}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from: crc32 of the id as text leaves 2 when divided by 4 (no id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column (null: empty)."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def rows_of(batches: Iterator[pa.RecordBatch], width: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, raw_texts(batch.column(batch.schema.get_field_index(width)))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per part, from one buffer."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind)).cast(pa.list_(kind))
