"""Token counts of whole texts by overlap resynchronisation.

A huge text is encoded in chunks that overlap. Two encodings are spliced at a
place inside the overlap where (1) white space follows a non-space in the text,
which no token of these tokenizers spans and behind which nothing depends on
what stood before, and (2) both encodings have a token boundary and then agree
on the following tokens up to the end of the overlap. Where there is none, the
overlap is widened until there is, or the text ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Encoder, encoder, packed_batches, vocabulary
from .common import small_batches, table

CHUNK_CHARS, OVERLAP_CHARS = 65_536, 512
_CUT = re.compile(r"(?<=\S)(?=\s)")


def _pieces(enc: Encoder, text: str, at: int) -> list[tuple[int, int, int]]:
    return [(at + a, at + b, i) for a, b, i in enc.spans(text)]


def resynchronised(enc: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[np.ndarray]:
    """Ids of ``text``, run by run; pieces of two chunks at most are held, unless no cut is found for longer."""
    if len(text) <= chunk + overlap or enc.kind != "tokenizers":
        yield enc.ids(text)
        return
    start, to = 0, chunk + overlap
    left = _pieces(enc, text[:to], 0)
    while to < len(text):
        mid, wide = to - overlap, overlap
        while True:
            right_to = min(len(text), mid + chunk + overlap)
            right = _pieces(enc, text[mid : max(right_to, to)], mid)
            cut = _stable(text, left, right, mid, to)
            if cut is not None or to == len(text):
                break
            wide *= 2
            to = min(len(text), mid + wide)
            left = _pieces(enc, text[start:to], start)
        if cut is None:
            break
        yield _joined(enc, [p for p in left if p[1] <= cut])
        start, to = cut, max(right_to, to)
        left = [p for p in right if p[0] >= cut]
    yield _joined(enc, left)


def _stable(text: str, left: list, right: list, lo: int, hi: int) -> int | None:
    """The last place in [lo, hi) from which both encodings agree as far as their common pieces reach, behind which at least one whole piece stands."""
    if hi >= len(text):
        hi = len(text)
    spaces = [m.start() for m in _CUT.finditer(text, lo, hi) if m.start() > lo]
    if not spaces:
        return None
    last = spaces[-1]  # pieces that end by here are not touched by where the left chunk breaks off
    a = [p for p in left if p[0] >= lo and p[1] <= last]
    b = [p for p in right if p[1] <= last]
    for cut in spaces[:-1]:
        tail = [p for p in a if p[0] >= cut]
        if tail and tail == [p for p in b if p[0] >= cut] and not any(p[0] < cut < p[1] for p in (*a, *b)):
            return cut
    return None


def _joined(enc: Encoder, pieces: list[tuple[int, int, int]]) -> np.ndarray:
    return np.array([p[2] for p in pieces], enc.dtype)


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` in place of ``text``.

    One narrow stage: no exchange, a row for each input row in no set order.
    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are kept. An
    empty table gives an empty table. Columns of those three names are replaced.
    The tokenizer is named or given as a path that every worker can open.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    schema = docs.select(*keep).schema
    for name, kind in (("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary(tokenizer))
        huge = lambda t: len(t) > chunk + overlap and enc.kind == "tokenizers"
        at = len(keep)
        for batch, ids in packed_batches(lambda texts: enc.packed_all(["" if huge(t) else t for t in texts]), batches, at):
            texts = batch.column(at).to_pylist()
            counts = [sum(map(len, resynchronised(enc, t, chunk, overlap))) if t and huge(t) else len(i) // enc.dtype.itemsize for t, i in zip(texts, ids)]
            n_bytes = [0 if not t else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(*keep, text).mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for every whole text of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
