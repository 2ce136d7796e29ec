"""Token ids as flat files of unsigned integers, with 64-bit document offsets.

A part holds the documents of one range of keys, in ascending order:

* ``part-00000.bin``: the ids, one after another, unsigned 16-bit if the
  vocabulary allows, else 32-bit, little-endian;
* ``part-00000.idx``: documents + 1 unsigned 64-bit offsets, in ids;
* ``part-00000.key``: the documents' keys, signed 64-bit (null: the least one).

Where a part's first id stands in the whole corpus comes from the prefix sums
of the parts' sizes. All three files of a part are written as its documents
come, and read in pieces, so neither side holds more than a batch of it. Files
are written under another name and renamed, so a task that runs again leaves
one whole file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, packed_batches, vocabulary
from .common import KeyRanges, partitions_for, scratch, small_batches, table, written

NULL_KEY = -(1 << 63)
#: Bytes of text that a part holds on average at most.
PART_BYTES = 64 << 20
#: Bytes of ids that a reader turns into one batch, and documents whose offsets it reads at once.
READ_BYTES, READ_DOCS = 16 << 20, 1 << 16
#: Ids of one document that a value of Spark can hold.
MOST_IDS = (1 << 29) - 1


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are, and for each part: (part, documents, ids, ids before it)."""

    path: str
    dtype: str
    parts: tuple[tuple[int, int, int, int], ...]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int | None = 1, key: str = "doc_id", text: str = "text", parts: int | None = None) -> TokenFiles:
    """Encode every whole text and write the files below ``path``, a folder that all executors share.

    Null texts count as empty: ``end_id`` alone. Documents are in ascending
    order of ``key`` (bigint), nulls first, rows of one key by a hash of their
    text. Other columns are not read. An empty table writes no part. Without
    ``parts`` there is one for each ``PART_BYTES`` of text, and as many as the
    session's shuffle partitions at least; a key that fills several parts by
    itself is cut by the hash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(partitions_for(spark), -(-size // PART_BYTES))
    ranges = KeyRanges(rows, "key", "text", parts)
    dealt = rows.repartitionById(ranges.count, ranges.part()).sortWithinPartitions("key", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary(tokenizer)), TaskContext.get().partitionId()
        width, tail = enc.dtype.itemsize, b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        where, folder = _open(path)
        where.create_dir(folder, recursive=True)
        stem, own = f"{folder}/part-{part:05d}", f".{uuid.uuid4().hex}"
        n = at = 0
        with where.open_output_stream(f"{stem}.bin{own}") as ids_out, where.open_output_stream(f"{stem}.idx{own}") as idx_out, where.open_output_stream(f"{stem}.key{own}") as key_out:
            idx_out.write(np.array([0], "<u8").tobytes())
            for batch, all_ids in packed_batches(enc.packed_all, batches, 1):
                sizes = []
                for ids in all_ids:
                    ids_out.write(ids + tail)
                    sizes.append((len(ids) + len(tail)) // width)
                ends = at + np.cumsum(sizes, dtype=np.int64)
                idx_out.write(ends.astype("<u8").tobytes())
                key_out.write(batch.column(0).fill_null(NULL_KEY).to_numpy().astype("<i8").tobytes())
                n, at = n + len(sizes), int(ends[-1]) if sizes else at
        for end in ("bin", "idx", "key"):
            where.move(f"{stem}.{end}{own}", f"{stem}.{end}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([n], pa.int64()), "ids": pa.array([at], pa.int64()), "width": pa.array([width], pa.int32())})

    made = written(dealt.mapInArrow(run, "part int, docs long, ids long, width int"), "parts").collect()  # a row a file
    before, found = 0, []
    for r in sorted(made, key=lambda r: r["part"]):
        if r["docs"]:
            found.append((r["part"], r["docs"], r["ids"], before))
            before += r["ids"]
    return TokenFiles(path, f"<u{made[0]['width'] if made else 2}", tuple(found))


class _Flat:
    """A file of numbers of one kind, read by ranges: memory-mapped where it is local."""

    def __init__(self, where: fs.FileSystem, path: str, kind: str):
        self.kind = np.dtype(kind)
        size = where.get_file_info(path).size
        self.count, rest = divmod(size, self.kind.itemsize)
        if rest:
            raise OSError(f"{path}: {size} bytes are no whole number of {self.kind} values")
        self.file = self.flat = None
        if not self.count:
            self.flat = np.empty(0, self.kind)
        elif isinstance(where, fs.LocalFileSystem):
            self.flat = np.memmap(path, self.kind, "r")
        else:
            self.file = where.open_input_file(path)

    def __getitem__(self, some: slice) -> np.ndarray:
        if self.flat is not None:
            return np.asarray(self.flat[some])
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((some.stop - some.start) * width, some.start * width), self.kind)


def read_token_files(spark: SparkSession, files: TokenFiles, key: str = "doc_id") -> DataFrame:
    """A row a document: ``key, start`` (ids before it in the corpus), ``n_tokens, ids`` (unsigned 32-bit little-endian), a task a part.

    Files are read by ranges, local ones through a memory map. A document of
    more than ``MOST_IDS`` ids is an error, since no value of Spark could hold
    them.
    """
    small_batches(spark)
    path, dtype = files.path, files.dtype
    rows = [(i, *p) for i, p in enumerate(files.parts)]
    parts = spark.createDataFrame(rows, "task int, part int, docs long, ids long, before long").repartitionById(max(1, len(rows)), "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _open(path)
        for batch in batches:
            for p in batch.to_pylist():
                stem, n = f"{folder}/part-{p['part']:05d}", p["docs"]
                keys, offsets, ids = (_Flat(where, f"{stem}.{end}", kind) for end, kind in (("key", "<i8"), ("idx", "<u8"), ("bin", dtype)))
                if (keys.count, offsets.count, ids.count) != (n, n + 1, p["ids"]) or int(offsets[n : n + 1][0]) != p["ids"]:
                    raise OSError(f"{stem}: the files do not have the documents and ids that were written")
                for lo in range(0, n, READ_DOCS):
                    hi = min(n, lo + READ_DOCS)
                    ends, own = offsets[lo : hi + 1].astype(np.int64), keys[lo:hi]
                    at = 0
                    while at < hi - lo:
                        to = max(at + 1, int(np.searchsorted(ends, ends[at] + READ_BYTES // 4, "right")) - 1)
                        if ends[at + 1] - ends[at] > MOST_IDS:
                            raise OSError(f"{stem}: document {lo + at} has more than {MOST_IDS} ids")
                        flat = ids[int(ends[at]) : int(ends[to])].astype("<u4")
                        places = (4 * (ends[at : to + 1] - ends[at])).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[at:to], pa.int64(), mask=own[at:to] == NULL_KEY), pa.array(ends[at:to] + p["before"], pa.int64()), pa.array(np.diff(ends[at : to + 1]), pa.int64()), pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(flat.tobytes())])],
                            names=[key, "start", "n_tokens", "ids"],
                        )
                        at = to

    return parts.mapInArrow(run, f"{key} long, start long, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, read the files back, and give each document's place and check sum."""
    files = write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "token-files"))
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
