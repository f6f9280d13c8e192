"""Texts in pieces: many rows with an order make one text that may be too long for a row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import small_batches


def digests(pieces: DataFrame, key: str, order: str, md: str = "md") -> DataFrame:
    """(key, md5, n): MD5 and characters of each key's pieces in a row. The state of the hash goes from piece to piece, in order, so a key is read by one task and never held."""
    small_batches(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda: pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], [key, "md5", "n"])
        own, state, n = None, None, 0
        for batch in batches:
            kind = batch.column(0).type
            for name, text, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or name != own:
                    if state is not None:
                        yield out()
                    own, state, n = name, hashlib.md5(usedforsecurity=False), 0
                state.update(text)
                n += size
        if state is not None:
            yield out()

    kind = pieces.schema[key].dataType.simpleString()
    rows = pieces.select(key, order, F.col(md).cast("binary").alias("b"), F.length(md).alias("size"))
    ordered = rows.repartition(key).sortWithinPartitions(key, order).select(key, "b", "size")
    return ordered.mapInArrow(run, f"`{key}` {kind}, md5 string, n long")


def joined(pieces: DataFrame, order: str, md: str = "md") -> DataFrame:
    """The pieces put together, one row for what they have beside order and md; for texts that fit a row."""
    whole = pieces.groupBy(*[c for c in pieces.columns if c not in (order, md)]).agg(F.sort_array(F.collect_list(F.struct(order, md))).alias(md))
    return whole.withColumn(md, F.array_join(F.transform(md, lambda p: p[md]), ""))
