"""Links of the near-dedup stage against Jaccard similarities known by construction."""

from __future__ import annotations

import random

from rateline.llm import simhash

SCHEMA = "doc_id long, text string"


def components(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_links_are_confirmed_on_whole_texts(spark):
    """Pairs just over and just under 0.8, of 500 distinct shingles each: 446 shared of 554 are 0.805, 443 of 557 are 0.795."""
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(40):
        shared = 443 if i % 2 else 446
        words = new(504)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[: shared + 4], *new(500 - shared)]))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + i % 2}
    assert components(spark, rows) == want


def test_passages_of_many_texts_lose_no_pair(spark, monkeypatch):
    """Pairs of 0.8 and more are found as in a small table where all texts share a passage, and so minima; also where these shards are split in parts."""
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = new(34)
    rows, want = [], {}
    for i in range(300):
        own = new(50)
        rows += [(2 * i + k, " ".join([*passage, *own, *new(10)])) for k in range(2)]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    assert components(spark, rows) == want
    monkeypatch.setattr(simhash, "SHARD_MAX", 150)
    assert components(spark, rows) == want
    monkeypatch.setattr(simhash, "PART_BYTES", 50_000)
    assert components(spark, rows) == want


def test_repeated_passages_do_not_hide_copies(spark):
    """One copy of each text has a passage a hundred times over; as sets of shingles the two are 0.96 alike."""
    rng = random.Random(7)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(100):
        own, passage = new(84), new(20)
        rows += [(2 * i, " ".join([*own, *passage])), (2 * i + 1, " ".join([*own, *passage * 100]))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    assert components(spark, rows) == want


def test_recall_and_precision_of_borderline_pairs(spark):
    """Thousands of pairs of 0.75 to 0.88, of 60 to 400 distinct shingles, whose similarity is counted here: of those of 0.8 and more at least 999 in 1000 are linked, of the others none."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, alike = [], {}
    for i in range(3000):
        n = rng.randint(64, 400)
        a = new(n)
        b = [*a[: round(n * rng.uniform(0.85, 0.95))]]
        b += new(n - len(b))
        x, y = shingles(a), shingles(b)
        alike[i] = len(x & y) / len(x | y)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = components(spark, rows)
    linked = {i for i in alike if got[2 * i] == got[2 * i + 1]}
    true = {i for i, s in alike.items() if s >= 0.8}
    assert linked <= true and len(true) > 1000 and len(alike) - len(true) > 500
    assert len(true - linked) <= len(true) / 1000


def test_rows_that_share_a_key(spark):
    """Unlike texts of one key stay apart; of copies, one row is first."""
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, b), (2, b), (None, a), (None, c), (None, c), (3, d), (3, d), (4, None), (5, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    first = sorted((str(r["doc_id"]), r["component_id"]) for r in got if r["is_first"])
    assert first == [("1", 1), ("1", 1), ("3", 3), ("3", 3), ("4", 4), ("None", None), ("None", None)]
