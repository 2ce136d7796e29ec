"""Line dedup by distinct-site spread, by DataFrame operations alone.

A HyperLogLog sketch of the sites of each line's hash is built in each task and
merged by aggregation. Lines whose estimate is within the sketch's error of the
threshold get an exact distinct count; the rest are settled by the estimate.
Lines on enough sites are boilerplate: all of their occurrences go but the
first, that of the least (key, line number, text hash).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: 2 ** LG_K registers a sketch; its standard error is about 1.04 / sqrt of that.
LG_K, DEVIATIONS = 12, 5
ERROR = DEVIATIONS * 1.04 / math.sqrt(2**LG_K)


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``h1, h2, first`` (struct of key, position and text hash) of lines on ``min_sites`` sites or more; ``lines`` has ``h1, h2, site, key, at, of``."""
    counted = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(F.struct("key", "at", "of")).alias("first"))
    possible = written(counted.where(F.col("sites") >= math.floor(min_sites * (1 - ERROR))), "spread")
    settled = F.col("sites") > math.ceil(min_sites * (1 + ERROR))
    near = possible.where(~settled)
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites)
    return possible.where(settled).select("h1", "h2", "first").unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with ``text`` freed of boilerplate lines, and ``n_lines``, ``n_removed``.

    Lines end at a line feed. A line counts if it has anything but spaces, and
    is boilerplate if the same line stands on ``min_sites`` distinct sites or
    more; a null site is one site of its own. Its first occurrence stays, so a
    document copied to many sites stays whole once. A null text stays null and
    has no lines; an empty one has one. Rows of the same key are told apart by
    their text, and where that is the same too, lose the same lines; of unlike
    texts of one key the line stays in one. Columns
    named ``n_lines`` or ``n_removed`` are replaced; others are kept. An empty
    table gives an empty table.

    Lines are shuffled as two 64-bit hashes, never as text; hot lines are
    combined in each task before, and the join back is one whose large keys
    Spark can split. The work on one text grows with its lines.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    body, row = F.col(text), F.xxhash64(text, F.length(text))
    split = docs.select(F.col(key).alias("key"), row.alias("of"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.split(body, "\n").alias("all"))
    exploded = split.select("key", "of", "site", F.posexplode_outer("all").alias("at", "line")).where(F.trim("line") != "")
    lines = exploded.select("key", "of", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.length("line"), "line").alias("h2"))
    common = written(boilerplate(lines, min_sites), "boilerplate")
    gone = lines.join(common, ["h1", "h2"]).where(~(F.struct("key", "at", "of").eqNullSafe(F.col("first")))).select("key", "of", "at").distinct()
    cut = gone.groupBy("key", "of").agg(F.collect_set("at").alias("cut")).select(F.col("key").alias("cut_key"), F.col("of").alias("cut_of"), "cut")
    marked = docs.select(*keep, row.alias("_of")).join(cut, F.col(key).eqNullSafe(F.col("cut_key")) & (F.col("_of") == F.col("cut_of")), "left")
    # what stands between two cuts is one slice, so each line is copied once; the structure is named by the outer transform, else its expressions would be made anew in the inner one
    whole = F.struct(F.split(body, "\n").alias("lines"), F.concat(F.array(F.lit(-1)), F.sort_array("cut"), F.array(F.size(F.split(body, "\n")))).alias("cuts"))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w["cuts"]) - 1), lambda i: F.slice(w["lines"], F.element_at(w["cuts"], i) + 2, F.element_at(w["cuts"], i + 1) - F.element_at(w["cuts"], i) - 1))
    left = F.get(F.transform(F.array(whole), lambda w: F.array_join(F.flatten(runs(w)), "\n")), F.lit(0))
    out = [F.when(F.col("cut").isNull(), body).otherwise(left).alias(text) if c == text else F.col(c) for c in keep]
    n_lines = F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return marked.select(*out, F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(F.col("cut").isNotNull(), F.size("cut")), F.lit(0)).cast("long").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on 10 sites or more."""
    got = dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS a FROM documents
), l AS (
  SELECT doc_id, site, unnest(generate_series(1, len(a))) AS pos, unnest(a) AS line FROM split
), c AS (
  SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
), r AS (
  SELECT l.doc_id, l.pos, row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.pos) AS nth FROM l JOIN c ON l.line = c.line
), g AS (
  SELECT doc_id, pos FROM r WHERE nth > 1
), k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN CAST(length(k.kept) AS BIGINT) END AS kept_chars, CASE WHEN d.text IS NOT NULL THEN sha256(k.kept) END AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
