"""Ranked lexical search by TPUT (three phases, uniform threshold) over term-partitioned postings.

A score is a sum over the terms of a query, and each term has a list of
postings ordered by what they add. To find a query's best documents,

1. the heads of its lists (as many as results are asked for) are fetched; sums
   over heads are lower bounds, and the k-th best of them is ``tau``;
2. every list is fetched down to the same threshold, ``tau`` divided by the
   number of lists. What is in none of them scores less than ``tau``. Sums of
   what was fetched are better lower bounds, whose k-th best is the new ``tau``;
   with the threshold in place of what was not fetched they are upper bounds,
   and what has one below ``tau`` is out;
3. what is left has its exact score looked up.

A list is fetched once for all queries. Fetched postings meet in blocks of
documents, where the sums of each query are made; no row is made for a pair of
query and document but for those that can still be results. Documents of one
length and the same counts of query terms score alike in every query, so they
are one entry of the postings, and become documents again at the end.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions_for, small_batches, table, written

#: Pairs of query and term that are searched for at once; what the driver and each task hold of queries.
PAIRS = 200_000
#: Entries of a block, in which the sums of phase 2 are made.
BLOCK = 8_192
#: Candidates of phase 3 that are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes that are part of no term become spaces, A-Z become lower case, and all others stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or bytes([b]).isalnum() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8; null has none."""
    return text.encode().translate(_FOLD).split() if text else []


def _numbered(items: DataFrame, text: str) -> DataFrame:
    """Queries as a written table with a number, ``item``, and their distinct ``terms``. Equal rows are one query, queries without terms are none."""
    names = [*items.columns, "terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(terms, pa.list_(pa.binary()))], names=names)

    rows = items.distinct().mapInArrow(run, T.StructType([*items.schema, T.StructField("terms", T.ArrayType(T.BinaryType()))]))
    return written(rows.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "search-items")


def _profiles(docs: DataFrame, index: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``key, n, sig, terms, tfs``: for each document with a term its length and its counts of query terms, whose digest is ``sig``."""
    schema = docs.select(key).schema.add("n", "long").add("sig", "binary").add("terms", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.keys()
        for batch in batches:
            at, sizes, sigs, terms, tfs = [], [], [], [], []
            for i, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                if words := terms_of(t):
                    counts = Counter(words)
                    own = sorted((index[w], counts[w]) for w in counts.keys() & known)
                    flat = np.array([(len(words), 0), *own], np.int64)
                    at.append(i)
                    sizes.append(len(words))
                    sigs.append(hashlib.blake2b(flat.tobytes(), digest_size=16).digest())
                    terms.append(flat[1:, 0])
                    tfs.append(flat[1:, 1])
            kept = batch.column(batch.schema.get_field_index(key)).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _postings(entries: DataFrame) -> DataFrame:
    """A row a term of an entry, with ``c``: what its occurrences add for each unit of the term's weight."""
    some = [c for c in entries.columns if c not in ("terms", "tfs", "m")]
    rows = entries.select(*some, "m", F.explode(F.arrays_zip("terms", "tfs")).alias("z")).select(*some, "m", F.col("z.terms").alias("term"), F.col("z.tfs").alias("tf"))
    return rows.select(*some, "term", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)").alias("c")).where("c > 0")


class _Queries:
    """Lists and thresholds of one slice of queries, as arrays; bounded by ``PAIRS``."""

    def __init__(self, items: list, index: dict[bytes, int], weight: dict[int, int]):
        self.terms = {r["item"]: [t for t in map(index.get, map(bytes, r["terms"])) if weight.get(t)] for r in items}
        self.weight = weight
        self.floors: list[tuple[int, int, int, int, list[tuple[int, int, int]]]] = []

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame([(i, t, self.weight[t]) for i, own in self.terms.items() for t in own], columns=["item", "term", "w"]).astype({"item": "int64", "term": "int32", "w": "int64"}), "item long, term int, w long")

    def thresholds(self, tau: dict[int, int], most: dict[int, int]) -> dict[int, int]:
        """Sets what phase 2 needs of each query, and returns how far down each list must be fetched for any of them.

        A value v is fetched where v * lists >= tau. One that is not is at most
        ``tau // lists``, and at most the list's largest. Lists whose largest is
        below the threshold are not fetched.
        """
        least: dict[int, int] = {}
        for item, own in self.terms.items():
            bar, asked, rest = tau.get(item, 0), [], 0
            share = bar // max(1, len(own))
            for t in own:
                w = self.weight[t]
                down = -(-bar // (len(own) * w))
                rest += min(share, w * most.get(t, 0))
                if most.get(t, 0) >= max(1, down):
                    asked.append((t, w, down))
                    least[t] = min(least.get(t, down), down)
            self.floors.append((item, bar, share, rest, asked))
        return least


def _bounds(queries: _Queries, k: int, tau: dict[int, int] | None = None):
    """The sums of one block of entries for each query: the ``k`` largest, or, with ``tau``, those whose upper bound reaches it."""
    floors = queries.floors

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, at = np.unique(pdf["entry"].to_numpy(), return_inverse=True)
        term, c = pdf["term"].to_numpy(), pdf["c"].to_numpy()
        order = np.lexsort((-c, term))
        term, c, at = term[order], c[order], at[order]
        ids, begins = np.unique(term, return_index=True)
        spans = dict(zip(ids.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(term)])))
        out = []
        for item, bar, share, rest, asked in floors:
            low, seen = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for t, w, down in asked:
                if t in spans:
                    a, b = spans[t]
                    b = a + int(np.searchsorted(-c[a:b], -down, "right"))
                    low[at[a:b]] += w * c[a:b]  # an entry has a term once
                    seen[at[a:b]] += 1
            kept = np.flatnonzero(seen)
            if tau is not None:
                kept = kept[(low + rest - seen * share)[kept] >= max(bar, tau.get(item, 0))]
            elif len(kept) > k:
                kept = kept[np.argpartition(low[kept], -k)[-k:]]
            out.append(pd.DataFrame({"item": np.full(len(kept), item, np.int64), "entry": own[kept], "low": low[kept]}))
        return pd.concat(out) if out else pd.DataFrame({"item": [], "entry": [], "low": []}).astype("int64")

    return run


def _kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """``item, bar``: the k-th largest value of each query that has k."""
    r = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(value)))
    return rows.withColumn("r", r).where(F.col("r") <= k).groupBy("item").agg(F.min(value).alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("item", "bar")


def _search(docs: DataFrame, items: DataFrame, k: int, key: str, text: str) -> DataFrame | None:
    """``item, rank, key, score`` for one slice of queries; nothing if no document has a term."""
    spark = docs.sparkSession
    asked = items.select("item", "terms").collect()  # at most PAIRS terms
    index = {t: i for i, t in enumerate(sorted({bytes(t) for r in asked for t in r["terms"]}))}
    profiles = written(_profiles(docs, index, key, text), "search-profiles")
    n, length = profiles.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n:
        return None
    m = f"10L + (cast(n as decimal(20,0)) * cast('{90 * n}' as decimal(18,0)) div cast('{length}' as decimal(38,0)))"
    same = profiles.where(F.size("terms") > 0).groupBy("sig").agg(F.first("n").alias("n"), F.first("terms").alias("terms"), F.first("tfs").alias("tfs"), F.count(F.lit(1)).alias("copies"))
    entries = written(same.select("sig", F.expr(m).alias("m"), "terms", "tfs", "copies", F.monotonically_increasing_id().alias("entry")), "search-entries")
    found = {r["term"]: r["df"] for r in entries.select(F.explode("terms").alias("term"), "copies").groupBy("term").agg(F.sum("copies").alias("df")).collect()}  # at most PAIRS
    queries = _Queries(asked, index, {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in found.items()})
    lists = F.broadcast(queries.lists(spark))  # at most PAIRS rows of 20 bytes

    ordered = [F.col("term"), F.col("c").desc(), F.col("entry")]
    postings = written(_postings(entries.select("entry", "m", "terms", "tfs")).repartitionByRange(partitions_for(spark), *ordered).sortWithinPartitions(*ordered), "search-postings")
    # Phase 1: heads of lists.
    r = F.row_number().over(Window.partitionBy("term").orderBy(F.col("c").desc(), "entry"))
    heads = written(postings.withColumn("r", r).where(F.col("r") <= k), "search-heads")
    tau = dict(_kth(heads.join(lists, "term").groupBy("item", "entry").agg(F.sum(F.col("w") * F.col("c")).alias("low")), "low", k).collect())
    least = queries.thresholds(tau, dict(heads.where("r = 1").select("term", "c").collect()))
    if not least:
        return None
    # Phase 2: all that reaches the uniform thresholds, summed in blocks of entries.
    down = F.broadcast(spark.createDataFrame(pd.DataFrame(sorted(least.items()), columns=["term", "down"]).astype({"term": "int32", "down": "int64"}), "term int, down long"))
    blocks = max(partitions_for(spark), -(-entries.count() // BLOCK))
    fetched = postings.join(down, "term").where(F.col("c") >= F.col("down")).select(F.pmod(F.xxhash64("entry"), F.lit(blocks)).alias("block"), "term", "entry", "c")
    sums = "item long, entry long, low long"
    tau = dict(_kth(fetched.groupBy("block").applyInPandas(_bounds(queries, k), sums), "low", k).collect())  # a row a query
    left = written(fetched.groupBy("block").applyInPandas(_bounds(queries, k, tau), sums).select("item", "entry"), "search-candidates")
    # Phase 3: exact scores of what is left.
    exact = entries.drop("copies").join(_small(left), "entry")
    scores = _postings(exact.select("item", "entry", "sig", "m", "terms", "tfs")).join(lists, ["item", "term"]).groupBy("item", "entry", "sig").agg(F.sum(F.col("w") * F.col("c")).alias("score"))
    best = F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))
    winners = written(scores.where("score > 0").withColumn("r", best).where(F.col("r") <= k).select("item", "sig", "score"), "search-winners")
    # Entries become documents: of each, no more than the k first can be results.
    first = F.row_number().over(Window.partitionBy("sig").orderBy(F.col(key).asc_nulls_last()))
    members = profiles.select(key, "sig").join(_small(winners.select("sig").distinct()), "sig").withColumn("r", first).where(F.col("r") <= k)
    last = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col(key).asc_nulls_last()))
    return winners.join(members.select(key, "sig"), "sig").withColumn("rank", last).where(F.col("rank") <= k).select("item", "rank", key, "score")


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` of a written table, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each query: the columns of ``items`` but its text, ``rank`` (int, from 1), ``key``, ``score`` (long).

    A document is a row: of repeated rows each has a rank of its own, and rows
    of one id are ranked by their own texts. Equal scores are in ascending order
    of ``key``, nulls last. Documents without a term, as null and empty texts,
    are not counted and never found; queries without a term, and those whose
    terms no document has, have no rows. Equal rows of ``items`` are one query.
    Columns of ``items`` named as results are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(item_text, *(c for c in items.columns if c not in (item_text, "rank", key, "score", "item", "terms")))
    queries = _numbered(items, item_text)
    pairs = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    slices = -(-pairs // PAIRS)
    own = [c for c in items.columns if c != item_text]
    found = None
    for i in range(slices):
        some = _search(docs, queries.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == i), k, key, text)
        if some is not None:
            found = some if found is None else found.union(written(some, "search-slice"))
    if found is None:
        found = queries.select("item").crossJoin(docs.select(key)).limit(0).select("item", F.lit(0).alias("rank"), key, F.lit(0).cast("long").alias("score"))
    return found.join(queries.select("item", *own), "item").select(*own, "rank", key, "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each ``benchmark`` item."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
g AS (SELECT count(*)::BIGINT AS n, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0 * (SELECT n FROM g) + 2) / (2.0 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
s AS (SELECT p.r, p.term, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + ((90 * len(d.words) * g.n) // g.l)))) AS v FROM p JOIN d USING (r) JOIN w USING (term), g),
t AS (SELECT q.item_id, q.text, s.r, sum(s.v)::BIGINT AS score FROM q JOIN s USING (term) GROUP BY ALL HAVING sum(s.v) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT t.item_id, d.doc_id, t.score, row_number() OVER (PARTITION BY t.item_id, t.text ORDER BY t.score DESC, d.doc_id ASC NULLS LAST) AS rank FROM t JOIN d USING (r)) WHERE rank <= 10
"""
