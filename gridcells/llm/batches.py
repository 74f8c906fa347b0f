"""Small Arrow helpers that the document operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from gridcells.runtime import ship

#: Rows and text bytes that one step inside a task handles at once.
SLICE_ROWS, SLICE_BYTES = 1024, 16 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that none holds over SLICE_ROWS rows, nor, unless a
    single text is longer, over about SLICE_BYTES of text. Texts stay whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
            stop = min(max(stop, at + 1), at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield column dicts (lists or arrays)."""
    parsed: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, arrow.field(k).type) for k, c in ((f.name, columns[f.name]) for f in arrow)], schema=arrow)

    ship(df.sparkSession)
    return df.mapInArrow(run, parsed)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def split_of(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5: remainder 0 marks held-out rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a short ASCII text. The polynomial is a fixed value."""
    codes = f"list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: ascii(x)::BIGINT)"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295)"
