"""I-Match document fingerprints.

Terms are kept if their inverse document frequency lies in a band: they stand
in at least ``DF_LEAST`` of the documents (and in 2) and at most ``DF_MOST``.
The lexicon that is left has at most (mean distinct terms of a document) /
``DF_LEAST`` entries, whatever the number of documents; up to ``LEXICON_MAX``
hashes are broadcast, and a larger one is joined with the texts' terms instead.

A fingerprint hashes the sorted distinct terms of a text in the whole lexicon,
and in several randomised subsets of it of several densities: sparse subsets
tell long texts apart by few terms, dense ones short texts. A text without any
term of the lexicon has the hash of all of its terms in the first place, so
that unlike texts stay unlike. The likeness of two fingerprints is the share
of equal hashes among places in which either text has a term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyRanges, partitions_for, small_batches, table, written

DF_LEAST, DF_MOST = 0.0005, 0.10
#: A subset of density 2**-d keeps a term whose hash has its d bits zero; so many subsets of each density.
DENSITIES, EACH = (3, 4, 5, 6, 7, 8, 9, 10), 6
SUBSETS = len(DENSITIES) * EACH
LEXICON_MAX = 5_000_000
#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 1_000_000
_DENSITY = [d for d in DENSITIES for _ in range(EACH)]
_SALT = np.array([e + 1 for _ in DENSITIES for e in range(EACH)], np.uint64)
_TURN = np.array([0x9E3779B97F4A7C15 + 2 * (d * EACH + e) for d in DENSITIES for e in range(EACH)], np.uint64)
_SHIFT = np.array([64 - d for d in _DENSITY], np.uint64)
_TERM = re.compile(r"\w+")
EMPTY = "0" * 8


def terms_of(text: str | None) -> set[str]:
    return set(_TERM.findall(text.lower())) if text else set()


def _hash(term: str) -> int:
    """As Spark's ``xxhash64`` of the term, unsigned."""
    return xxhash.xxh64_intdigest(term.encode(), 42)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, df`` over all documents; each task hands on sums of its own."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "df"])
            seen.clear()
            return got

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(terms_of(t))
            if len(seen) > HELD_TERMS:
                yield out()
        yield out()

    return docs.select(text).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """``h`` (a 64-bit hash), ``kept``: the terms in the band, and (not kept) those above it, of which there are at most (mean distinct terms of a document) / ``DF_MOST``; and how many are in the band."""
    n = docs.count()
    least, most = max(2, DF_LEAST * n), max(2, DF_MOST * n)
    found = document_frequencies(docs, text).where(F.col("df") >= least).select(F.xxhash64("term").alias("h"), (F.col("df") <= most).alias("kept"))
    found = written(found, "lexicon")
    return found, found.where("kept").count()


def _hashes(terms: DataFrame) -> np.ndarray:
    """Column ``h`` as sorted unsigned numbers, 8 bytes each; the caller has bounded them."""
    return np.unique(terms.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def _known(terms: set[str], known: dict[str, int]) -> np.ndarray:
    """Hashes of sorted terms."""
    return np.array([known[t] if t in known else known.setdefault(t, _hash(t)) for t in sorted(terms)], np.uint64)


def _inside(own: np.ndarray, lex: np.ndarray) -> np.ndarray:
    if not len(lex) or not len(own):
        return np.zeros(len(own), bool)
    return lex[np.minimum(np.searchsorted(lex, own), len(lex) - 1)] == own


def _spelled(own: np.ndarray, instead: int) -> str:
    """The fingerprint of kept terms' hashes; ``instead`` stands in the first place if there are none."""
    # all subsets at once: the first d bits of the term's hash, after a turn of its own for each subset, are zero
    chosen = ((own[None, :] ^ _SALT[:, None]) * _TURN[:, None]) >> _SHIFT[:, None] == 0
    out = [f"{xxhash.xxh32_intdigest(own.tobytes(), 0) or 1:08x}" if len(own) else f"{instead:08x}"]
    for row, some, d in zip(chosen, chosen.any(1), _DENSITY):
        out.append(f"{xxhash.xxh32_intdigest(own[row].tobytes(), d) or 1:08x}" if some else EMPTY)
    return "".join(out)


def _instead(every: np.ndarray) -> int:
    return (xxhash.xxh32_intdigest(every.tobytes(), 1) or 1) if len(every) else 0


def fingerprint(terms: set[str], lex: np.ndarray, known: dict[str, int]) -> str:
    """8 hex digits for the lexicon and each subset, zeros where the text has none of its terms."""
    every = _known(terms, known)
    return _spelled(every[_inside(every, lex)], _instead(every))


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among places in which either text has a term; 1 if neither text has any term at all."""
    x, y = ([s[i : i + 8] for i in range(0, len(s), 8)] for s in (a, b))
    some = [(p, q) for p, q in zip(x, y) if p != EMPTY or q != EMPTY]
    return sum(p == q for p, q in some) / len(some) if some else float(a == b)


def edited(text: str, after: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``after``, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _joined(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rid, fingerprint`` of ``rows`` (``rid, text``) by a join of their terms with the lexicon. Terms above the band, which would be hot keys of the join, are left out before."""
    common = rows.sparkSession.sparkContext.broadcast(_hashes(terms.where(~F.col("kept"))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > HELD_TERMS:
                known.clear()
            for rid, t in zip(*(c.to_pylist() for c in batch.columns)):
                every = _known(terms_of(t), known)
                at = np.flatnonzero(~_inside(every, common.value))
                h = np.append(every[at].view(np.int64), _instead(every))  # the last one is no term
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), rid)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(h)], names=["rid", "nth", "h"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_spelled(np.array([x["h"] for x in own[1:]], np.int64).view(np.uint64), own[0]["h"]) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["rid", "fingerprint"])

    pairs = rows.mapInArrow(spread, "rid long, nth int, h long")
    some = pairs.where("nth >= 0").join(terms.where("kept").select("h"), "h", "left_semi").select("rid", "nth", "h").unionByName(pairs.where("nth < 0"))
    return some.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("nth", "h"))).alias("own")).mapInArrow(spell, "rid long, fingerprint string")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` of each row's whole text. Null texts are empty and, like texts without a word, have a fingerprint of zeros. No other columns are read; repeated rows stay; an empty table gives an empty table."""
    small_batches(docs.sparkSession)
    terms, n = lexicon(docs, text)
    if n > LEXICON_MAX:
        rows = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).alias("text")), "texts")
        return rows.join(_joined(rows.select("rid", "text"), terms), "rid").select(F.col("key").alias(key), "fingerprint")
    lex = docs.sparkSession.sparkContext.broadcast(_hashes(terms.where("kept")))
    schema = docs.select(key).schema.add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > HELD_TERMS:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(terms_of(t), lex.value, known) for t in batch.column(1).to_pylist()], pa.string())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, home, ghost`` with each row before the one that comes after it in its partition: keys descend, rows of one key by a hash of their text, null keys last, and after the last row comes the first.

    Rows are dealt out by ranges, once, together with a copy of each range's
    highest row (``ghost``) for the range above; ``home`` is a row's own range.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = KeyRanges(rows, "key", "text", partitions_for(docs.sparkSession))
    placed = rows.withColumn("home", ranges.part()).withColumn("h", F.xxhash64("text"))
    tops = {r[0]: r[1] for r in placed.groupBy("home").agg(F.max(F.struct(F.col("key").isNotNull().alias("some"), "key", "h"))).collect()}  # a row a range
    full = sorted(tops)
    above = {p: full[(i + 1) % len(full)] for i, p in enumerate(full)}

    def of_home(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("home") + 1)

    each = [tops.get(p) for p in range(ranges.count)]
    is_top = F.col("key").eqNullSafe(of_home([t and t["key"] for t in each], "long")) & (F.col("h") == of_home([t and t["h"] for t in each], "long"))
    goes = of_home([above.get(p, 0) for p in range(ranges.count)], "int")
    own, copy = F.struct(F.col("home").alias("to"), F.lit(False).alias("ghost")), F.struct(goes.alias("to"), F.lit(True).alias("ghost"))
    dealt = placed.select("key", "text", "home", "h", F.explode(F.when(is_top, F.array(own, copy)).otherwise(F.array(own))).alias("x")).select("key", "text", "home", "h", "x.to", "x.ghost")
    return dealt.repartitionById(ranges.count, "to").sortWithinPartitions("ghost", F.desc_nulls_last("key"), F.desc("h"), F.desc("text")).select("key", "text", "home", "ghost")


def _in_pairs(batches: Iterator[pa.RecordBatch], made) -> Iterator[list[tuple]]:
    """For each batch, the rows of ``neighbours`` as ``made`` has them, each with the one after it. A range that has only copies gives nothing."""
    held, done = None, False
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)) if not done else ():
            now = made(row)
            if held is not None:
                out.append((held, now))
            held, done = (None, True) if row[3] else (now, False)
            if done:
                break
        yield out
    if held is not None:
        raise AssertionError("a range of keys came without the row below it")


EDITS = "key long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`` of each row, where the next document is that of the next lower key and, after the last, the first.

    Null texts are empty. Rows of one key come by a hash of their text; rows
    without a key come last. A single row is its own next one. Very long texts
    are held one at a time. Repeated rows stay. No other columns are read; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if docs.isEmpty():
        return spark.createDataFrame([], EDITS).withColumnRenamed("key", key)
    terms, n = lexicon(docs, text)
    ordered = neighbours(docs, key, text)
    names = [c.split()[0] for c in EDITS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    if n <= LEXICON_MAX:
        lex = spark.sparkContext.broadcast(_hashes(terms.where("kept")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, int] = {}
            for pairs in _in_pairs(batches, lambda r: (r[0], r[1], fingerprint(terms_of(r[1]), lex.value, known))):
                out = []
                for (k, t, own), (_, after, following) in pairs:
                    new = edited(t, after)
                    other = fingerprint(terms_of(new), lex.value, known)
                    out.append((k, len(t), new, own, other, likeness(own, other), likeness(own, following)))
                if len(known) > HELD_TERMS:
                    known.clear()
                yield batch_of(out, names, kinds)

        return ordered.mapInArrow(run, EDITS).withColumnRenamed("key", key)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nth = TaskContext.get().partitionId() << 33, -1

        def numbered(row: tuple) -> tuple:
            nonlocal nth
            nth += 1
            return row[0], row[1], row[2] << 33 if row[3] else own + nth  # a copy is the first of its range

        for pairs in _in_pairs(batches, numbered):
            yield batch_of([(i, k, t, edited(t, after), j) for (k, t, i), (_, after, j) in pairs], ["rid", "key", "text", "edited", "next"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])

    rows = written(ordered.mapInArrow(lines, "rid long, key long, text string, edited string, next long"), "texts")
    plain = written(_joined(rows.select("rid", "text"), terms), "fingerprints")
    other = _joined(rows.select("rid", F.col("edited").alias("text")), terms)
    whole = rows.join(plain, "rid").join(other.withColumnRenamed("fingerprint", "edited_fingerprint"), "rid").join(plain.select(F.col("rid").alias("next"), F.col("fingerprint").alias("following")), "next")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield batch_of([(*r[:5], likeness(r[3], r[4]), likeness(r[3], r[5])) for r in rows], names, kinds)

    return whole.select("key", F.char_length("text").cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint", "following").mapInArrow(compared, EDITS).withColumnRenamed("key", key)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document; ``edits`` says what holds of nulls, ties and empty tables."""
    got = edits(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
