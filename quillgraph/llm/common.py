"""Shared helpers: scratch tables in the cluster's shared folder, salted ranks, UTF-8 views of Arrow columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.scratch import materialize, remove, scratch_base, scratch_path  # noqa: F401

#: ASCII white space that separates words: space and code points 9 to 13.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(id_col: str, mod: int):
    """crc32 of the id written as text, modulo mod."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def utf8_view(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of an Arrow string or binary array, without a copy. Nulls count as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offsets, dtype=kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[o[0] : o[-1]], o - o[0]


#: Bytes of text that a task takes at a time where it makes Python objects of them.
RUN_BYTES = 4 << 20


def text_runs(batch, at: int, most: int = RUN_BYTES, most_rows: int = 1 << 15):
    """Slices of a batch whose texts in column `at` have about `most` bytes; a longer text stands alone."""
    offsets = utf8_view(batch.column(at))[1]
    first, rows = 0, batch.num_rows
    while first < rows:
        last = max(first + 1, min(int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1, first + most_rows, rows))
        yield batch.slice(first, last - first)
        first = last


#: Keys that are joined by a broadcast because they hold more than one in so many of all rows; so there are fewer of them than this.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], many: str, *columns: str) -> DataFrame:
    """Inner join of rows with a table of distinct keys and their numbers of rows, for its columns.

    Rows of hot keys never meet in one task: a hot key has more than 1 / HOT_KEYS of the sum of `many`,
    so fewer than HOT_KEYS keys are sent to all tasks. Both inputs are read several times: written tables.
    """
    total = table.agg(F.sum(many)).first()[0] or 0
    is_hot = F.col(many) * HOT_KEYS > F.lit(total)
    hot, cold = table.where(is_hot).select(*keys, *columns), table.where(~is_hot).select(*keys, *columns)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def release_memory(keep_tokens: bool = False) -> None:
    """Give freed memory back at the end of a task: Python workers are used again by later stages, beside the executor's heap.

    A vocabulary and its caches go too, unless the stage's next task uses them.
    """
    import ctypes
    import gc

    import pyarrow as pa

    from quillgraph.llm import tokens

    if not keep_tokens:
        tokens.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it keeps what it keeps
        pass
