"""Best-fit decreasing packing of token pieces into sequences.

The plan is made on the histogram of piece lengths, which has at most
``capacity`` rows however many documents there are. Lengths are taken from the
largest down; a segment tree over remaining capacities gives the tightest open
bins in logarithmic time, and all pieces of one length that meet bins of one
remaining capacity are placed at once. The outcome is, for every length, a few
runs of ranks, and a piece finds its place from its rank among the pieces of
its length. Ranks come from prefix sums of counts by partition, so that pieces
stay where they were encoded.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, packed_batches, vocabulary
from .common import small_batches, table, written

#: A table of counts by partition and length is broadcast up to this size, and joined by key beyond it; and what a row of it takes once it is hashed.
BROADCAST_BYTES = 32 << 20
BASE_ROW_BYTES = 128


class CapacityTree:
    """Segment tree over the remaining capacities 0..capacity: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.any = bytearray(2 * self.size)

    def put(self, remaining: int, some: bool) -> None:
        i = remaining + self.size
        self.any[i] = some
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of ``least`` or more that an open bin has."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` pieces of each length.

    Gives (length, first rank, pieces a bin, first bin, offset): from the first
    rank on, bins in turn take that many pieces each, from that offset.
    """
    tree, free, runs, bins = CapacityTree(capacity), defaultdict(list), [], 0

    def open_(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            free[remaining].append((first, n))
            tree.put(remaining, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = free[room].pop()
                if not free[room]:
                    tree.put(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                open_(room - each * length, first, full)
            if full < n and left:  # fewer than a bin takes
                runs.append((length, rank, each, first + full, capacity - room))
                open_(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            open_(room, first + full, n - full)
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The encoded documents in pieces: ``key, piece, start, length, ids`` (unsigned 32-bit little-endian), ``part``, and ``nth``, a piece's number among those of its length in its part."""
    small_batches(docs.sparkSession)
    schema = docs.select(key).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary").add("part", "integer").add("nth", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(vocabulary(tokenizer)), TaskContext.get().partitionId(), Counter()
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch, all_ids in packed_batches(enc.packed_all, batches, 1):
            rows = []
            for i, packed in enumerate(all_ids):
                ids = np.frombuffer(packed, enc.dtype).astype("<u4").tobytes() + tail
                at, n, piece = 0, len(ids) // 4, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity)
                    rows.append((i, piece, at, to - at, ids[4 * at : 4 * to]))
                    at, piece = to, piece + 1
            nth = []
            for r in rows:
                nth.append(seen[r[3]])
                seen[r[3]] += 1
            at, piece, start, length, ids = map(list, zip(*rows)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64())],
                names=schema.names,
            )

    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A row a piece: ``key, piece, start, length, ids, sequence_id, offset``;
    ``ids`` are unsigned 32-bit little-endian. Only documents longer than a
    sequence are cut, into full pieces after a first one that may be shorter.
    Null texts count as empty and hold ``end_id`` alone (no row if that is
    None). Rows with the same or a null key are packed as documents of their
    own. Other columns are not kept, so none can clash. An empty table gives an
    empty table.

    The encoded pieces are written once to the shared folder; what is gathered
    is a histogram of at most ``capacity`` rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, key, text), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit_runs(hist, capacity)
    by_length = defaultdict(list)
    for length, *run in runs:
        by_length[length].append(tuple(run))
    plan = spark.createDataFrame(list(by_length.items()), "length long, runs array<struct<first:long,each:long,bin:long,at:long>>")
    base = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    if counts.count() * BASE_ROW_BYTES <= BROADCAST_BYTES:
        base = F.broadcast(base)
    rank = F.col("nth") + F.coalesce("before", F.lit(0))
    placed = pieces.join(base, ["part", "length"]).join(F.broadcast(plan), "length").withColumn("rank", rank).withColumn("run", F.expr("element_at(filter(runs, r -> r.first <= rank), -1)"))
    n = F.col("rank") - F.col("run.first")
    return placed.select(
        key, "piece", "start", "length", "ids",
        (F.col("run.bin") + F.floor(n / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + (n % F.col("run.each")) * F.col("length")).cast("long").alias("offset"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, with the check sum of each piece's ids."""
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
