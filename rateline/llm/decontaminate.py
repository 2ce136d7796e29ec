"""Benchmark decontamination by winnowing, by DataFrame operations alone.

Of every 6 consecutive 5-word grams the least hash is kept, in documents and in
benchmark items alike. Two texts that share 10 words share the 6 grams of those
words, so they keep the same least one: no shared span of 10 words or more is
missed. Kept hashes are joined; where they meet, the hit is extended to the
whole window, which must be equal word for word. Items of fewer than 10 words
are one window each, with all grams of their length kept (a window of one).

The first pass carries hashes only, and drops all documents without a match;
texts are looked at again for the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _each(n: Column, f) -> Column:
    """``f(i)`` for i in 1..n; none if n is below 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.array())


def _grams(size: int) -> Column:
    """Hashes of all grams of ``words``. The gram's size goes into the hash."""
    return _each(F.size("words") - (size - 1), lambda i: F.xxhash64(F.lit(size), F.slice("words", i, size)))


def _texts(size: int) -> Column:
    return _each(F.size("words") - (size - 1), lambda i: F.array_join(F.slice("words", i, size), " "))


def _kept(n: int) -> Column:
    """The least of the ``grams`` in each window of ``n`` grams."""
    return _each(F.size("grams") - (n - 1), lambda i: F.array_min(F.slice("grams", i, n)))


# The outer forms of explode below: from an inner one Spark infers a filter on the
# array and pushes it to the scan, where the array's whole expression is inlined
# into its own lambdas and the text is cut into words anew for every gram.


def _windows(rows: DataFrame, short: list[int]) -> DataFrame:
    """All windows of ``words``, by their kept hash: the other columns, ``at`` (from 1), ``size``, ``hash``, ``said``."""
    own = [c for c in rows.columns if c != "words"]
    long = rows.withColumn("grams", _grams(GRAM)).withColumn("kept", _kept(WINDOW)).withColumn("said", _texts(SPAN))
    sets = [long.select(*own, F.lit(SPAN).alias("size"), F.arrays_zip("kept", "said").alias("z"))]
    for n in short:
        sets.append(rows.withColumn("kept", _grams(n)).withColumn("said", _texts(n)).select(*own, F.lit(n).alias("size"), F.arrays_zip("kept", "said").alias("z")))
    found = None
    for s in sets:
        s = s.select(*own, "size", F.posexplode_outer("z").alias("at", "x")).where("x.kept IS NOT NULL").select(*own, (F.col("at") + 1).alias("at"), "size", F.col("x.kept").alias("hash"), F.col("x.said").alias("said"))
        found = s if found is None else found.unionByName(s)
    return found


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """``item, size, hash, said`` of every window of the items, and the sizes below ``SPAN``."""
    rows = written(items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0), "items")
    n = F.size("words")
    short = sorted(r[0] for r in rows.where(n < SPAN).select(n.alias("n")).distinct().collect())  # 9 at most
    found = [_windows(rows.where(n >= SPAN), [])]
    found += [_windows(rows.where(n == k), [k]).where(F.col("size") == k) for k in short]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return written(out.select("item", "size", "hash", "said").distinct(), "windows"), short


def row_hash(text: str) -> Column:
    """Tells rows of one key apart."""
    return F.xxhash64(text, F.length(text))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text_hash, n_words, n_hit, n_items, items`` (sorted ids, as strings) ``, contaminated`` of each row of ``docs``; ``text_hash`` is ``row_hash(text)``.

    A word is hit if it lies in an occurrence of a window of an item. Null and
    empty texts have no words; items without words have no window; an item's
    id may repeat and counts once, a null one hits words but is not listed.
    Rows of one key are judged by their own text. Empty tables on either side
    are fine, and no other columns are read.
    """
    bench, short = benchmark_windows(items)
    rows = docs.select(F.col(key).alias("key"), row_hash(text).alias("of"), F.col(text).alias("text"))
    words = rows.select("key", "of", words_of(F.col("text")).alias("words"))
    sifted = words.withColumn("grams", _grams(GRAM)).select("key", "of", F.array_distinct(F.concat(_kept(WINDOW), *[_grams(n) for n in short])).alias("kept"))
    met = sifted.select("key", "of", F.explode_outer("kept").alias("hash")).join(bench.select("hash").distinct(), "hash", "left_semi")
    some = written(met.select("key", "of").distinct(), "candidates")
    again = words.alias("w").join(some.alias("s"), F.col("w.key").eqNullSafe(F.col("s.key")) & (F.col("w.of") == F.col("s.of")), "left_semi")
    hits = _windows(again, short).join(bench.select("hash", "size", "said").distinct(), ["hash", "size", "said"], "left_semi")
    hits = written(hits.select("key", "of", "at", "size", "said").distinct(), "hits")
    row = Window.partitionBy("key", "of").orderBy("at", "size")
    end = F.col("at") + F.col("size") - 1
    before = F.coalesce(F.max(end).over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = hits.select("key", "of", F.greatest(F.lit(0), end - F.greatest(before, F.col("at") - 1)).alias("new")).groupBy("key", "of").agg(F.sum("new").cast("long").alias("n_hit"))
    in_items = hits.select("key", "of", "size", "said").distinct().join(bench.select("size", "said", "item").distinct(), ["size", "said"]).groupBy("key", "of").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = covered.alias("c").join(in_items.alias("i"), F.col("c.key").eqNullSafe(F.col("i.key")) & (F.col("c.of") == F.col("i.of"))).select(F.col("c.key").alias("k"), F.col("c.of").alias("o"), "n_hit", "items")
    found = written(found, "found")
    counted = rows.select("key", "of", F.coalesce(F.regexp_count("text", F.lit(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))), F.lit(0)).cast("long").alias("n_words"))
    whole = counted.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("of") == F.col("o")), "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(F.col("key").alias(key), F.col("of").alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), ip AS (
  SELECT item, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM iw WHERE len(w) > 0
), iwin AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM ip
), ks AS (
  SELECT DISTINCT k FROM iwin
), dp AS (
  SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k
), dwin AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM dp
), hit AS (
  SELECT d.doc_id, d.k, d.i, b.item FROM dwin d JOIN iwin b ON d.k = b.k AND d.s = b.s
), pos AS (
  SELECT doc_id, k, i, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hit)
), nh AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM pos GROUP BY doc_id
), ni AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(nh.n_hit, 0) AS n_hit, coalesce(ni.n_items, 0) AS n_items,
  sha256(coalesce(ni.items, '')) AS items_sha256, coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh ON dw.doc_id = nh.doc_id LEFT JOIN ni ON dw.doc_id = ni.doc_id
"""
