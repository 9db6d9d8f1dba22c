"""A filter of keys with a fixed number of bits: what it rejects is not among the keys, however many there are.

Its size never grows with the data, so it may go to every task. Over very many keys it
fills up and passes more, which costs a shuffle of more rows and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import release_memory


def place(*keys: str, bits: int = 23) -> Column:
    """A key's place in the filter."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def build(rows: DataFrame, *keys: str, bits: int = 23) -> np.ndarray:
    """2**bits bits as 64-bit words; 2**(bits - 6) rows at most reach the driver."""
    words = rows.select(place(*keys, bits=bits).alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return table


def passes(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def _split(table: np.ndarray, keep: bool):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            got = passes(table, batch.column(batch.num_columns - 1).to_numpy())
            yield batch.filter(pa.array(got if keep else ~got)).select(batch.schema.names[:-1])
        release_memory()

    return run


def _joined(rows: DataFrame, other: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Join on keys that may be null."""
    right = other.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(right, same, how)


def without(rows: DataFrame, dropped: DataFrame, *keys: str) -> DataFrame:
    """rows (all columns) whose keys are not in dropped: only rows that the filter of dropped keys passes are shuffled."""
    table = build(dropped, *keys)
    placed = rows.withColumn("_place", place(*keys))
    clean = placed.mapInArrow(_split(table, False), rows.schema)
    maybe = placed.mapInArrow(_split(table, True), rows.schema)
    return clean.unionByName(_joined(maybe, dropped, keys, "left_anti"))


def within(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """rows (all columns) whose keys are in wanted: only rows that the filter passes are shuffled."""
    maybe = rows.withColumn("_place", place(*keys)).mapInArrow(_split(build(wanted, *keys), True), rows.schema)
    return _joined(maybe, wanted, keys, "left_semi")
