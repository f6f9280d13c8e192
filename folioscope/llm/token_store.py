"""Token ids as one concatenated array with Elias-Fano document boundaries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.batches import pieces
from folioscope.llm.chunks import library_encoder, vocabulary_path
from folioscope.runtime import scratch_path, small_batches

#: Ids after which a segment is closed; a document is never split.
SEGMENT_IDS = 1 << 18
#: Boundaries between two samples of the select structure.
SAMPLE = 256

SEGMENT = "shard long, seq long, start_in_shard long, n_docs long, n_tokens long, width int, ids binary, doc_ids binary, null_ids int, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(largest / count) bits each, with select.

    The low bits of each value lie side by side; the high parts are one unary bit vector. The
    position of every SAMPLE-th one is kept as a 32-bit integer, so select reads one stretch.
    """

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.count, self.low_bits = count, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        count = len(values)
        if count == 0:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, int(values[-1] // count).bit_length() - 1)
        ones = (values >> bits) + np.arange(count)
        if ones[-1] >= 1 << 32:
            raise ValueError("a segment's boundaries must fit 32-bit samples")
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        low = (values[:, None] >> np.arange(bits)) & 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(count, bits, pack(low), pack(high), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1."""
        if first >= last:
            return np.zeros(0, np.int64)
        block = first // SAMPLE
        begin = int(self.samples[block]) // 8
        after = (last - 1) // SAMPLE + 1
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        ones = ones[ones >= self.samples[block]]
        at = np.arange(first, last)
        high = ones[at - block * SAMPLE] - at
        bits = at[:, None] * self.low_bits + np.arange(self.low_bits)
        low = ((self.low[bits >> 3] >> (bits & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)
        return (high << self.low_bits) + low.sum(axis=1)

    def get(self, k: int) -> int:
        return int(self.select(k, k + 1)[0])


def _segment(shard: int, seq: int, start: int, ids: list[bytes], doc_ids: list[int | None]) -> dict:
    joined = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if len(joined) == 0 or joined.max() < 1 << 16 else 4
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids]))
    nulls = sum(x is None for x in doc_ids)  # they come first
    return {
        "shard": shard, "seq": seq, "start_in_shard": start, "n_docs": len(ids), "n_tokens": len(joined), "width": width,
        "ids": joined.astype(f"<u{width}").tobytes(), "doc_ids": np.array(doc_ids[nulls:], "<i8").tobytes(), "null_ids": nulls,
        "low_bits": ends.low_bits, "low": ends.low.tobytes(), "high": ends.high.tobytes(), "samples": ends.samples.tobytes(),
    }


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2) -> None:
    """Encode every whole text, append end_id and write the ids in ascending order of id below `path`.

    One shuffle deals rows by ranges of id; each task sorts its range and writes it as one
    shard, a row of segments. A segment holds the concatenated ids (2 bytes each where they
    fit), its documents' ids, and its boundaries as an Elias-Fano sequence. Spark's committer
    makes the files, so a lost task is written again and any file system will do. Null texts
    are empty (the end id alone). Null ids come first. Repeated ids stay, ordered by a hash of the text.
    """
    vocabulary = vocabulary or vocabulary_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, end = TaskContext.get().partitionId(), library_encoder(vocabulary), end_id.to_bytes(4, "little")
        schema = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("start_in_shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.binary()), ("null_ids", pa.int32()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
        seq = start = size = 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, size
            row = _segment(shard, seq, start, ids, names)
            seq, start, size = seq + 1, start + row["n_tokens"], 0
            ids.clear()
            names.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), encoder.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids.append(x + end)
                names.append(name)
                size += len(ids[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text")).select("id", "text")
    ordered.mapInArrow(run, SEGMENT).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)


def read_store(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document of a store; with `digest`, ids_crc32 in place of ids.

    `start` counts the ids of all documents before, over all shards: a shard's first start
    is the sum of the shards before it, from one row for each shard.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    small_batches(spark)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row a shard, not one a document.
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8):
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                count = row["n_docs"]
                index = EliasFano(count, row["low_bits"], row["low"], row["high"], row["samples"])
                ends = index.select(0, count)
                starts = np.concatenate(([0], ends[:-1]))
                names = [None] * row["null_ids"] + np.frombuffer(row["doc_ids"], "<i8").tolist()
                own = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array(own, pa.binary())
                base = row["base"] + row["start_in_shard"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(starts + base), pa.array(ends - starts), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
                )

    return segments.join(F.broadcast(bases), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as a store and read back from its files."""
    path = scratch_path(spark, "tokens")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path, digest=True)
