"""Removal of repeated byte strings by a sampled suffix array.

Of every 35 consecutive 16-byte grams the one of the least hash is an anchor.
Two equal strings of 50 bytes hold the same 35 grams, so both hold the same
anchor at the same place, and it is enough to compare the neighbourhoods of
equal anchors: 34 bytes before and 50 from the anchor on.

Equal neighbourhoods are one class of suffixes and need no sorting: all of a
class but those in its first document are repeats throughout. What is left are
anchors whose neighbourhood is new in part, at the edges of repeated passages.
Their neighbourhoods are sorted by deep-shallow sorting, once to the right and
once to the left; strings of 50 bytes that hold the anchor at one offset are
equal where runs of sufficient common prefix meet in both orders.

Tasks combine equal neighbourhoods before anything is shuffled, so a passage
that very many documents share costs one row a task and anchor.

A gram may stand in very many unlike neighbourhoods (runs of spaces, common
phrases). Beyond ``CROWD`` of them they are not sorted together but by what
stands beside the gram: two strings of 50 bytes that are equal and hold it
share the 17 bytes before it or the 17 bytes behind it, so each neighbourhood
goes to these two. Contexts that are crowded still (long rules of dashes) are
settled by an aggregation over their strings of 50 bytes. All of this concerns
only where the work is done; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for, small_batches, table, written
from .suffix_sort import deep_shallow

SPAN, GRAM = 50, 16
BEFORE = SPAN - GRAM
WIDE = BEFORE + SPAN
#: Window starts that are looked at together, anchors that a task combines together, and rows that are sorted together at least.
PIECE, HELD, SORTED = 1 << 20, 1 << 20, 200_000
#: Bytes of text whose anchors are sought together, and what parts the texts then.
SOUGHT, GAP = 1 << 18, bytes(SPAN)
#: Neighbourhoods of one gram, and of one gram and context, that are sorted together at most.
CROWD, CONTEXT_CROWD = 2_000, 50_000
#: Bytes beside the gram that equal strings share on one side at least.
BESIDE = (SPAN - GRAM + 1) // 2
#: What marks an anchor of a crowded gram beside its reach, which is below ``REACH``.
REACH, LONE = 1 << 12, 1 << 30
#: One document in so many is looked at to see which grams are crowded before anchors are dealt out.
LOOKED_AT = 64
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` of each n consecutive values, by doubling."""
    have = 1
    while 2 * have <= n:
        x = best(x[: len(x) - have], x[have:])
        have *= 2
    return best(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams of bytes, along the last axis."""
    g, size = _BYTE[data], 1
    while size < GRAM:
        n = g.shape[-1] - size
        g = g[..., :n] * _ODD[size.bit_length()] + (g[..., size:] ^ (g[..., size:] >> np.uint64(23)))
        size *= 2
    return _mixed(g)


def anchors(data: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of a byte array; of several texts in one, those in windows that are whole in a text (``whole``, for each window's start)."""
    windows = len(data) - SPAN + 1
    at, hashes = [], []
    for lo in range(0, max(0, windows), PIECE):
        hi = min(windows, lo + PIECE)
        g = _grams(data[lo : hi + SPAN - 1])
        least = _slide(g, SPAN - GRAM + 1, np.minimum)
        if whole is not None:
            least = np.where(whole[lo:hi], least, np.uint64(0))
        edge = np.zeros(BEFORE, np.uint64)
        most = _slide(np.concatenate([edge, least, edge]), SPAN - GRAM + 1, np.maximum)
        own = np.flatnonzero(most == g)
        at.append(own + lo)
        hashes.append(g[own])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(at) == 1:
        return at[0], hashes[0]
    places, first = np.unique(np.concatenate(at), return_index=True)
    return places, np.concatenate(hashes)[first]


def _joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one array with zeros before, between and behind them, and where they start and how long they are."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    return np.frombuffer(GAP.join([b"", *data, b""]), np.uint8), np.cumsum(sizes + SPAN) - sizes, sizes


def _around(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbourhoods of places in joined texts, padded with zeros, and how far each really reaches before and from the anchor."""
    return np.lib.stride_tricks.sliding_window_view(flat, WIDE)[start + at - BEFORE], np.minimum(at, BEFORE), np.minimum(size - at, SPAN)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes, each as one value."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, rows.size + 1, WIDE, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(near: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The other way round."""
    return np.frombuffer(b"".join(near.to_numpy(zero_copy_only=False) if isinstance(near, pa.Array) else near.to_numpy()), np.uint8).reshape(-1, WIDE)


def _lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many structs each row of a column of lists has (null: none), and the structs' fields, one row after another."""
    flat = column.flatten()
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), [flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)]


def _hashed(rows: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """64 bits for each row of bytes and its seed."""
    wide = -(-rows.shape[1] // 8)
    words = np.zeros((len(rows), 8 * wide), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view("<u8")
    h = seed.astype(np.uint64) * _ODD[15]
    for j in range(wide):
        h = _mixed((h ^ words[:, j]) * _ODD[j])
    return h


def _class(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _hashed(rows, left * 64 + right)


def _merged(rid: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, joined where they touch."""
    if not len(a):
        return rid, a, b
    order = np.lexsort((a, rid))
    rid, a, b = rid[order], a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = rid[1:] != rid[:-1]
    base = np.cumsum(new) * (int(b.max()) + 1)
    ends = np.maximum.accumulate(base + b) - base  # so far, within the document
    new[1:] |= a[1:] > ends[:-1]
    starts = np.flatnonzero(new)
    return rid[starts], a[starts], np.maximum.reduceat(b, starts)


def _found(docs: DataFrame) -> DataFrame:
    """Anchors of every document (``doc, text[, rid]``): ``g, c, doc, ab[, rid]`` with the place and the reach (64 * left + right) in ``ab``. Of neighbourhoods that a smaller document of the same task has there is only the repeated span, its start and length in ``ab``; there ``c`` is null, and ``g`` is arbitrary. These rows are what is shuffled most of, so they have no more columns than that."""
    several = "rid" in docs.columns
    names = ["g", "c", "doc", "ab", *["rid"] * several]

    def combined(g, c, doc, rid, at, reach) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, c, g))
        g, c, doc, rid, at, reach = (x[order] for x in (g, c, doc, rid, at, reach))
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        again = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        of, a, b = _merged(rid[again], (at - reach // 64)[again], (at + reach % 64)[again])
        ours = ~again
        sets = [(g[ours], c[ours], doc[ours], at[ours] << 31 | reach[ours], rid[ours]), (_mixed(of.astype(np.uint64) + a.astype(np.uint64)), None, of, a << 31 | (b - a), of)]
        for gs, cs, *rest in sets:
            for lo in range(0, len(gs), 50_000):
                s = slice(lo, lo + 50_000)
                n = len(gs[s])
                third = pa.nulls(n, pa.int64()) if cs is None else pa.array(cs[s].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(gs[s].view(np.int64)), third, *(pa.array(x[s].astype(np.int64)) for x in rest[: len(names) - 2])], names=names)

    def found(data: list[bytes], of: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        flat, start, size = _joined(data)
        whole = np.zeros(len(flat) - SPAN + 1, bool)
        for x, n in zip(start.tolist(), size.tolist()):
            whole[x : x + n - SPAN + 1] = True
        at, g = anchors(flat, whole)
        which = np.searchsorted(start, at, "right") - 1
        at = at - start[which]
        rows, left, right = _around(flat, start[which], size[which], at)
        doc, rid = np.array(of, np.int64)[which].T
        return g, _class(rows, left, right), doc, rid, at, left * 64 + right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            data, of, sought = [], [], 0
            for doc, text, rid in zip(columns[0], columns[1], columns[-1] if several else columns[0]):
                if text and len(own := text.encode()) >= SPAN:
                    data.append(own)
                    of.append((doc, rid))
                    sought += len(own)
                if sought >= SOUGHT:
                    held.append(found(data, of))
                    size += len(held[-1][0])
                    data, of, sought = [], [], 0
                if size >= HELD:
                    yield from combined(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
            if data:
                held.append(found(data, of))
                size += len(held[-1][0])
        if held:
            yield from combined(*map(np.concatenate, zip(*held)))

    return docs.select("doc", "text", *["rid"] * several).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated(rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each neighbourhood, the least and the greatest offset of its anchor in strings of 50 bytes that a smaller document has too, at the same offset; -1 if there is none."""
    order_r, lcp_r = deep_shallow(np.ascontiguousarray(rows[:, BEFORE:]))
    order_l, lcp_l = deep_shallow(np.ascontiguousarray(rows[:, :BEFORE][:, ::-1]))
    n = len(rows)
    least, most = np.full(n, -1), np.full(n, -1)
    run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(BEFORE + 1):
        run_r[order_r], run_l[order_l] = np.cumsum(lcp_r < SPAN - o), np.cumsum(lcp_l < o)
        own = np.flatnonzero((left >= o) & (right >= SPAN - o))
        if len(own) < 2:
            continue
        key = run_r[own] * (n + 2) + run_l[own]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        new = np.ones(len(own), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        first = np.minimum.reduceat(doc[own], starts)[np.cumsum(new) - 1]
        hit = own[doc[own] > first]
        least[hit] = np.where(least[hit] < 0, o, least[hit])
        most[hit] = o
    return least, most


def _contexts(rows: np.ndarray, left: np.ndarray, right: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which neighbourhoods go to which keys of a gram and what stands beside it."""
    before, behind = np.flatnonzero(left >= BESIDE), np.flatnonzero(right >= GRAM + BESIDE)
    at = BEFORE + GRAM
    keys = _hashed(rows[before, BEFORE - BESIDE : BEFORE], _mixed(g[before])), _hashed(rows[behind, at : at + BESIDE], _mixed(g[behind] + np.uint64(1)))
    return np.concatenate([before, behind]), np.concatenate(keys)


def _by_strings(near: DataFrame) -> DataFrame:
    """``rid, a, b``: repeated spans around anchors of crowded contexts, from the least document of each string of 50 bytes that holds the anchor."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rid, at, reach = (batch.column(i).to_numpy() for i in range(4))
            rows = _rows(batch.column(4))
            for o in range(BEFORE + 1):
                own = np.flatnonzero((reach // 64 >= o) & (reach % 64 >= SPAN - o))
                h = _hashed(rows[own, BEFORE - o : BEFORE - o + SPAN], np.full(len(own), o + 1))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[own]), pa.array(rid[own]), pa.array(at[own] - o)], names=["h", "doc", "rid", "a"])

    all_ = near.select("doc", "rid", "at", "reach", "near").mapInArrow(strings, "h long, doc long, rid long, a long")
    first = all_.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h", "low")
    return all_.join(first, "h").where("doc > low").groupBy("rid", "a").agg((F.col("a") + SPAN).alias("b"))


def _edges(near: DataFrame) -> DataFrame:
    """``rid, a, b``: repeated spans around anchors of new neighbourhoods (``k, doc, rid, at, reach, near``), those of one ``k`` together."""
    ordered = near.repartition(partitions_for(near.sparkSession), "k").sortWithinPartitions("k")

    def spans(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rows = _rows(t["near"])
        reach, at = t["reach"].to_numpy(), t["at"].to_numpy()
        least, most = repeated(rows, reach // 64, reach % 64, t["doc"].to_numpy())
        own = least >= 0
        return pa.RecordBatch.from_arrays([pa.array(t["rid"].to_numpy()[own]), pa.array(at[own] - most[own]), pa.array(at[own] - least[own] + SPAN)], names=["rid", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            if held and sum(h.num_rows for h in held) >= SORTED and len(g):
                last = held[-1].column(0)[-1].as_py()
                cut = int((g == last).sum()) if g[0] == last else 0
                if cut < len(g):  # the key that was begun ends here
                    yield spans([*held, batch.slice(0, cut)])
                    held, batch = [], batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield spans(held)

    return ordered.mapInArrow(run, "rid long, a long, b long")


def _crowded(docs: DataFrame, parts: int) -> list[int]:
    """Grams that seem to stand in more neighbourhoods than half of what a task gets, from the anchors of one document in ``LOOKED_AT``; ``2 * parts`` at most. They are only dealt out differently."""
    some = _found(docs.where(F.pmod(F.xxhash64("doc"), F.lit(LOOKED_AT)) == 0)).where("c IS NOT NULL")
    by = written(some.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "looked-at")
    least = max((by.agg(F.sum("n")).first()[0] or 0) / (2 * parts), CROWD / LOOKED_AT)
    return [r["g"] for r in by.where(F.col("n") > least).orderBy(F.desc("n")).limit(2 * parts).collect()]


def dedup_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept`` (binary) of each row: every byte is removed that lies in a string of 50 bytes which also starts in a document of a smaller key.

    Texts are UTF-8 bytes, so what is kept may break a character. Null texts
    are empty. Null keys are smaller than all others. Documents of one key
    never remove from each other; rows of one key and text get one result each.
    No other columns are read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    several = not docs.groupBy(key).count().where("count > 1").isEmpty()
    rid = F.xxhash64(doc, text) if several else doc
    rows = docs.select(F.col(key).alias("key"), rid.alias("rid"), doc.alias("doc"), F.col(text).alias("text"))
    distinct = rows.dropDuplicates(["rid"]) if several else rows
    source, parts = distinct if several else distinct.drop("rid"), partitions_for(spark)
    crowded = _crowded(source, parts)
    spread = F.col("g").isin(crowded) & F.col("c").isNotNull() if crowded else F.lit(False)
    # dealt once, by gram, which serves both windows; crowded grams, which are marked in "ab", by class
    k, mark = F.when(spread, F.xxhash64("g", "c")).otherwise(F.col("g")), F.when(spread, F.col("ab").bitwiseOR(F.lit(LONE))).otherwise(F.col("ab"))
    dealt = _found(source).select(k.alias("k"), "c", "doc", mark.alias("ab"), *["rid"] * several).repartition(parts, "k")
    by_class, by_gram = Window.partitionBy("k", "c"), Window.partitionBy("k")
    anchor, new = F.col("c").isNotNull(), F.col("c").isNotNull() & (F.col("doc") == F.col("first"))
    told = dealt.withColumn("first", F.min("doc").over(by_class)).withColumn("low", F.min(F.when(new, F.col("doc"))).over(by_gram)).withColumn("high", F.max(F.when(new, F.col("doc"))).over(by_gram)).withColumn("many", F.count(F.when(new, F.lit(1))).over(by_gram) > CROWD)
    # either a repeated span, or (reach not null) an anchor whose neighbourhood is new, of a gram that another document may have
    place, rest = F.shiftright("ab", 31), F.col("ab").bitwiseAND(F.lit((1 << 31) - 1))
    reach, lone = rest.bitwiseAND(F.lit(REACH - 1)), anchor & (rest.bitwiseAND(F.lit(LONE)) != 0)
    start = F.when(anchor & ~new, place - F.shiftright(reach, 6)).otherwise(place)
    stop = F.when(anchor & ~new, place + reach.bitwiseAND(F.lit(63))).when(~anchor, place + rest)
    crowd = F.when(lone | F.col("many"), F.lit(REACH)).otherwise(F.lit(0))
    told = told.where(~new | lone | (F.col("low") < F.col("high"))).select(F.when(new, reach + crowd).alias("reach"), F.col("rid" if several else "doc").alias("rid"), start.alias("a"), stop.alias("b"))
    told = written(told, "anchors")

    places = told.where(F.col("reach").isNotNull()).groupBy("rid").agg(F.collect_list(F.struct("a", "reach")).alias("places"))

    def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, (places_, reaches) = _lists(batch.column(3))
            flat, start, size = _joined([t.encode() for t in batch.column(2).to_pylist()])
            which, rids, docs_ = np.repeat(np.arange(len(counts)), counts), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo in range(0, len(which), 50_000):
                own, at, reach = (x[lo : lo + 50_000] for x in (which, places_, reaches))
                near, left, right = _around(flat, start[own], size[own], at)
                g = _grams(near[:, BEFORE : BEFORE + GRAM])[:, 0]
                plain, many = np.flatnonzero(reach < REACH), np.flatnonzero(reach >= REACH)
                some, keys = _contexts(near[many], left[many], right[many], g[many])
                to, ks = np.concatenate([plain, many[some]]), np.concatenate([g[plain], keys]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ks), pa.array(docs_[own[to]]), pa.array(rids[own[to]]), pa.array(at[to]), pa.array(reach[to] % REACH), _binary(near[to]), pa.array(np.arange(len(to)) >= len(plain))],
                    names=["k", "doc", "rid", "at", "reach", "near", "context"],
                )

    near = distinct.join(places, "rid").select("rid", "doc", "text", "places").mapInArrow(neighbourhoods, "k long, doc long, rid long, at long, reach long, near binary, context boolean")
    near = written(near, "neighbourhoods")
    full = written(near.where("context").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CONTEXT_CROWD).select("k"), "crowded")
    if full.isEmpty():
        edges = _edges(near)
    else:
        edges = _edges(near.join(full, "k", "left_anti")).unionByName(_by_strings(near.where("context").join(full, "k", "left_semi")))
    edges = written(edges, "edges")
    spans = told.where(F.col("reach").isNull()).select("rid", "a", "b").unionByName(edges).groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")).withColumnRenamed("rid", "of")
    whole = rows.join(spans, F.col("rid") == F.col("of"), "left").select("key", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            counts, (starts, stops) = _lists(batch.column(2))
            of, a_, b_ = _merged(np.repeat(np.arange(len(counts)), counts), starts, stops)
            bounds = np.searchsorted(of, np.arange(len(counts) + 1)).tolist()
            for text, lo, hi in zip(batch.column(1).to_pylist(), bounds, bounds[1:]):
                data, a, b = (text or "").encode(), a_[lo:hi], b_[lo:hi]
                ends = [0, *(x for s in zip(a.tolist(), b.tolist()) for x in s), len(data)]
                out.append((len(data), int((b - a).sum()), len(a), b"".join(data[x:y] for x, y in zip(ends[::2], ends[1::2]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary())))] if out else [batch.column(0), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = whole.select("key").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return whole.mapInArrow(cut, schema).withColumnRenamed("key", key)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes removed from all of ``documents``."""
    got = dedup_spans(table(spark, sf_dir, "documents"))
    return got.select(F.col("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
