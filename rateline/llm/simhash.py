"""SimHash fingerprints, and their near duplicates by BK-trees over shards.

A BK-tree keeps each fingerprint below its parent by their Hamming distance; a
search for radius r follows only edges within r of the distance to the node.

Shards are such that any two fingerprints that must be linked meet in one.
With radius r and r + s blocks of bits, two fingerprints within r have s equal
blocks, so there is a shard for every s blocks and value of them. s grows with
the number of fingerprints, which keeps trees small. Most trees are built where
their shard is, by an exchange on the shard's key: trees of all fingerprints
have no size bound, and must not pass the driver. Trees of shards beyond
``SHARD_MAX``, which many tasks must search, are broadcast while they have
``TREES_MAX`` nodes or fewer together; beyond that such shards are split, and
each pair of parts is a tree and its searches.

Shards link what they find as stars, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import partitions_for, small_batches, table, written
from .components import stars

BITS = 64
#: Fingerprints in one tree at most, and what a shard of blocks should hold on average.
SHARD_MAX, SHARD_MEAN = 20_000, 256
#: Nodes of all trees that are broadcast together, at some 250 bytes each.
TREES_MAX = 1 << 18
#: Bytes of shingle hashes that a part of a shard holds on average.
PART_BYTES = 16 << 20
#: Similar documents meet by pairs of hash minima; so many pairs.
PAIRS = 9
#: What is added by xor for each order of hashes: a fixed rule, the first bits of multiples of the golden ratio.
_TURN = np.array([0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(2 * PAIRS)], dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text, repeats included; ASCII case is folded, words end at ASCII white space."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, n, digest = memoryview(b" ".join(found)), max(1, len(found) - words + 1), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: n - 1]]
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[-n:])), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        ones += np.unpackbits(hashes[at : at + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` (the fingerprint's bits as a bigint) of each row. Null texts have no words: fingerprint zero."""
    small_batches(docs.sparkSession)
    schema = docs.select(key).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def _meeting(own: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes, one of two minima each, the least of the hashes in two orders. Orders that only multiply would not do: what is least stays so after most others, so that they agree or fail together."""
    least = np.full(2 * PAIRS, np.iinfo(np.uint64).max)
    for lo in range(0, len(own), 1 << 14):
        least = np.minimum(least, _mixed(own[lo : lo + (1 << 14), None] ^ _TURN).min(0))
    return _mixed(_mixed(least[::2] + np.arange(PAIRS, dtype=np.uint64)) ^ least[1::2])


def _node(own: np.ndarray) -> int:
    """One bigint for a set of shingle hashes, which are in order."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64))


def _signatures(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """``key, text_hash, fp`` (of the distinct shingles) ``, node`` (stands for the set of them) ``, n`` (its size) ``, keys`` (of the shards where it meets similar ones) of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.xxhash64(text, F.length(text)).alias("text_hash"), F.col(text))
    schema = rows.select(key, "text_hash").schema.add("fp", "long").add("node", "long").add("n", "long").add("keys", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes, sizes, keys = [], [], [], []
            for t in batch.column(2).to_pylist():
                own = np.unique(shingle_hashes(t, words))
                fps.append(simhash(own))
                nodes.append(_node(own))
                sizes.append(len(own))
                keys.append(_meeting(own).view(np.int64).tolist() if len(own) else [])
            cols = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)


def _shingle_sets(texts: DataFrame, words: int, text: str) -> DataFrame:
    """``node, shingles`` (the distinct shingle hashes in order, 64 bits each) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingle_hashes(t, words)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(o) for o in own], pa.int64()), pa.array([o.tobytes() for o in own], pa.binary())], names=["node", "shingles"])

    return texts.select(text).mapInArrow(run, "node long, shingles binary")


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.below = fps, [{} for _ in range(len(fps))]
        plain = fps.tolist()
        for i in range(1, len(plain)):
            at = 0
            while (to := self.below[at].setdefault((plain[at] ^ plain[i]).bit_count(), i)) != i:
                at = to

    def search(self, queries: np.ndarray, radius: int, found: Callable[[int, np.ndarray], None]) -> None:
        """Call ``found(node, which queries)`` for each node with queries within the radius. All queries go down together, each along the edges within its radius."""
        stack = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while stack:
            node, who = stack.pop()
            d = np.bitwise_count(queries[who] ^ self.fps[node]).astype(np.int16)
            if (near := who[d <= radius]).size:
                found(node, near)
            for edge, child in self.below[node].items():
                if (sub := who[np.abs(d - edge) <= radius]).size:
                    stack.append((child, sub))


def linked(fps: np.ndarray, radius: int, split: int | None = None, alike: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links (i, j), as stars, that connect what pairs within the radius connect.

    Entries from ``split`` on are searched in a tree of those before it; without
    it, all in a tree of all. ``alike(i, js)`` may turn pairs down. Pairs that
    are connected already are not looked at again.
    """
    label = np.arange(len(fps))
    base = 0 if split is None else split

    def found(node: int, near: np.ndarray) -> None:
        others = base + near
        others = others[label[others] != label[node]]
        if alike is not None and others.size:
            others = others[alike(node, others)]
        if others.size:
            mine = np.unique(np.append(label[others], label[node]))
            label[np.isin(label, mine)] = mine[0]

    BKTree(fps[: base or len(fps)]).search(fps[base:], radius, found)
    return [(i, int(to)) for i, to in enumerate(label) if to != i]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with the same first columns, from batches in their order."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(c[a] for c in cols)
            if own != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = own
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _shards(nodes: DataFrame, keys, radius: int) -> DataFrame:
    """Links ``a, b`` between nodes (``node, fp``) that meet under one of ``keys`` (an array of bigint pairs)."""
    dealt = nodes.select("node", "fp", F.explode(keys).alias("k")).select("k.t", "k.v", "node", "fp")
    large = written(dealt.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_MAX), "large-shards")
    total = large.agg(F.sum("n")).first()[0] or 0
    one = lambda rows: _links(rows.select("t", "v", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "fp"), radius)
    if not total:
        return one(dealt)
    if total <= TREES_MAX:
        crowded = dealt.join(large, ["t", "v"], "left_semi")
        return one(dealt.join(large, ["t", "v"], "left_anti")).unionByName(_by_broadcast(crowded, radius, -(-total // SHARD_MAX)))
    parts = F.ceil(F.coalesce("n", F.lit(1)) / SHARD_MAX).cast("int")
    return _links(_parted(dealt.join(large, ["t", "v"], "left").withColumn("parts", parts), ["node", "fp"]), radius)


def _by_broadcast(rows: DataFrame, radius: int, tasks: int) -> DataFrame:
    """Links ``a, b`` of shards (``t, v, node, fp``) whose trees every task gets; the caller has bounded their nodes. Each task searches for its share of the rows, and joins what it finds to stars over the whole tree."""
    got = rows.toArrow().sort_by([("t", "ascending"), ("v", "ascending"), ("node", "ascending")])
    trees = {key: (t["node"].to_numpy(), BKTree(t["fp"].to_numpy().view(np.uint64))) for key, t in _groups(iter(got.select(["t", "v", "node", "fp"]).combine_chunks().to_batches()), 2)}
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in _groups(batches, 2):
            nodes, tree = sent.value[key]
            asked, label = np.searchsorted(nodes, own["node"].to_numpy()), np.arange(len(nodes))

            def found(node: int, near: np.ndarray) -> None:
                joined = np.unique(np.append(label[asked[near]], label[node]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]

            tree.search(tree.fps[asked], radius, found)
            some = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], names=["a", "b"])

    return rows.repartition(tasks).sortWithinPartitions("t", "v", "node").mapInArrow(run, "a long, b long")


def _parted(dealt: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of shards in ``parts`` parts, for a task for each pair ``i, j`` of parts; the tree of the first one is searched for the second, which is ``side`` 1."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j"), (o < F.col("own")).cast("int").alias("side")))
    return dealt.withColumn("own", own).select("t", "v", F.explode(pairs).alias("p"), *carried).select("t", "v", "p.i", "p.j", "p.side", *carried)


def _links(dealt: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """Links ``a, b`` that each shard finds; with ``similarity``, only between nodes whose ``shingles`` have at least that Jaccard similarity."""
    ordered = dealt.repartition(partitions_for(dealt.sparkSession), "t", "v", "i", "j").sortWithinPartitions("t", "v", "i", "j", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for (_, _, i, j), rows in _groups(batches, 4):
            if rows.num_rows > 1:
                fps, node = rows["fp"].to_numpy().view(np.uint64), rows["node"].to_numpy()
                split = None if i == j else int((rows["side"].to_numpy() == 0).sum())
                if split is None or 0 < split < len(fps):
                    test = None if similarity is None else _similar(rows["shingles"].to_pylist(), similarity)
                    for x, y in linked(fps, radius, split, test):
                        a.append(node[x])
                        b.append(node[y])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def _similar(sets: list[bytes], least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of some sets of hashes have at least that share of their union in common: counted, not estimated."""
    ends = [0, *accumulate(len(s) // 8 for s in sets)]
    sizes = np.diff(ends)
    placed: list[np.ndarray] = []

    def alike(i: int, js: np.ndarray) -> np.ndarray:
        out = np.zeros(len(js), bool)
        some = np.flatnonzero(np.minimum(sizes[js], sizes[i]) >= least * np.maximum(sizes[js], sizes[i]) - 1e-6)
        if not some.size:
            return out
        if not placed:  # hashes by their places among all of the shard
            all_, at = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)
            placed.extend((at, np.zeros(len(all_), bool)))
        at, mark = placed
        mine = at[ends[i] : ends[i + 1]]
        mark[mine] = True
        for x in some.tolist():
            j = js[x]
            shared = np.count_nonzero(mark[at[ends[j] : ends[j + 1]]])
            out[x] = shared >= least * (sizes[i] + sizes[j] - shared) - 1e-6
        mark[mine] = False
        return out

    return alike


def block_keys(n: int, radius: int):
    """Shard keys of ``fp``: the values of every s of radius + s blocks, s such that a shard holds SHARD_MEAN of n on average."""
    s = 1
    while n / 2 ** (BITS * s / (radius + s)) > SHARD_MEAN and s < 4:
        s += 1
    cuts = [round(BITS * i / (radius + s)) for i in range(radius + s + 1)]
    block = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for t, chosen in enumerate(combinations(range(radius + s), s)):
        value, width = F.lit(0).cast("long"), 0
        for c in chosen:
            value, width = value.bitwiseOR(F.shiftleft(block[c], width)), width + cuts[c + 1] - cuts[c]
        keys.append(F.struct(F.lit(t).cast("long").alias("t"), value.alias("v")))
    return F.array(*keys)


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, component_id`` of each row; ``component_id`` is the least key that links of ``radius`` or fewer differing bits reach.

    Null, empty and wordless texts have fingerprint zero and are linked like
    any other; fewer words than a shingle make one of all. Repeated rows stay,
    each with its own result; rows with a null key take part, and a component
    of null keys alone has a null id. Other columns aren't read. An empty table
    gives an empty table.
    """
    fps = written(fingerprints(docs, words, key, text), "fingerprints")
    distinct = written(fps.groupBy(F.col("fp").alias("node")).agg(F.min(key).alias("least")), "distinct")
    nodes = distinct.select("node", F.col("node").alias("fp"))
    roots = stars(_shards(nodes, block_keys(distinct.count(), radius), radius))
    return _labelled(fps, distinct, roots, "fp").select(key, "fp", "component_id")


def _labelled(rows: DataFrame, distinct: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """``rows`` with the least ``least`` of their component's nodes, as ``component_id``."""
    whole = distinct.join(roots.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(whole.join(least, "root").select(F.col("node").alias(by), "component_id"), by)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text_hash, component_id, is_first`` of each row: groups of documents that share at least ``similarity`` of their distinct word shingles (Jaccard). ``text_hash`` is ``xxhash64(text, length(text))``.

    ``is_first`` is true for one row of each group, the one of the least key
    (nulls last), and of these of the least text hash; rows of the same key and
    text are all first or none. ``component_id`` is that row's key, null if no
    row of the group has one.

    Fingerprints are over distinct shingles too. Of two documents of similarity
    0.8 they differ in 10 of 64 bits on average, with a deviation of 3, so
    ``radius`` is wide and links are confirmed on all distinct shingle hashes.
    No blocks of bits serve such a radius; shards are keyed by pairs of hash
    minima, of which two documents of similarity 0.8 share one but in 1 of
    10,000 cases, at every size of table; large shards are split in parts. A
    passage that very many documents share makes them meet only where it holds
    both minima. Only texts that meet another one are read again for their
    hashes, one text for each set of shingles. Rows of equal sets are joined
    before. Null, empty and wordless texts form one group; repeated rows stay;
    other columns aren't read; an empty table gives an empty table.
    """
    signed = written(_signatures(docs, words, key, text), "signatures")
    least = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "text_hash")
    distinct = written(signed.groupBy("node").agg(F.min(least).alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("text_hash").alias("text_hash")), "distinct")
    dealt = distinct.select("node", "n", F.posexplode("keys").alias("t", "v")).select(F.col("t").cast("long").alias("t"), "v", "node", "n")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / SHARD_MAX), F.ceil(F.sum("n") * 8 / PART_BYTES), F.lit(1)).cast("int")
    shards = dealt.groupBy("t", "v").agg(F.count(F.lit(1)).alias("of"), parts.alias("parts")).where("of > 1")
    met = written(dealt.join(shards, ["t", "v"]).select("t", "v", "node", "parts"), "met")
    wanted = distinct.join(met.select("node").distinct(), "node", "left_semi").select("node", "fp", "text_hash")
    texts = docs.select(F.xxhash64(text, F.length(text)).alias("text_hash"), text).groupBy("text_hash").agg(F.first(text).alias(text))
    sets = _shingle_sets(texts.join(wanted, "text_hash", "left_semi"), words, text).join(wanted.select("node", "fp"), "node")
    roots = stars(_links(_parted(met.join(sets, "node"), ["node", "fp", "shingles"]), radius, similarity))
    got = _labelled(signed.select(key, "text_hash", "node"), distinct.select("node", "least"), roots, "node")
    first = F.col(key).eqNullSafe(F.col("component_id.key")) & (F.col("text_hash") == F.col("component_id.text_hash"))
    return got.select(key, "text_hash", F.col("component_id.key").alias("component_id"), first.alias("is_first"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    got = simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
