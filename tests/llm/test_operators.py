"""Each operator against a plain version of itself, on the awkward rows of ``docs``."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rateline.llm import chat_format as chat
from rateline.llm import bpe, imatch, language, packing, simhash, suffix_dedup, suffix_sort, token_files
from rateline.llm.bpe import Encoder, vocabulary
from rateline.llm.components import stars
from rateline.llm.decontaminate import decontaminate
from rateline.llm.line_dedup import dedup_lines
from rateline.llm.suffix_dedup import dedup_spans
from rateline.llm.token_counts import resynchronised, token_counts

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_ids_are_the_librarys(name, rows, monkeypatch):
    """With and without cuts, and where the cache has had enough."""
    enc, lib = Encoder(vocabulary(name)), library(name)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 7)
    odd = ["it's I'LL don't'", "  lead  trail  \n\n x ", "ΑΣ Σ", "é é", "İ", "\x00\x01", "a b", "<|startoftext|>A<|endoftext|>", "1234 abc123", "\t x\r\n"]
    odd += ["日本 語\u3000x  y", "a\u00a0b c\x1cd \x85 e", "e \u0301 a\u0301 \u1100\u1161 n", "Σ ΣΑΣ. ΑΣ\nB", "ends in space \n", " ", "\n\n", "x" * 100 + " y", "<|endoftext|> <|ENDOFTEXT|>a<|endoftext|>\n", "'s 't' LL'LL", "\U0001f469\u200d\U0001f4bb  z"]
    assert enc.cuts
    for t in [t or "" for _, t in rows] + odd + odd:
        assert enc.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t[:50]
    rng, alphabet = random.Random(4), ["a", "B", " ", "  ", "\n", "\t", "'s", "1", "é", "\u0301", "日", "\u00a0", "<|endoftext|>", "-", "Σ", "\r"]
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(1, 12)))
        assert enc.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_spliced_chunks_equal_the_whole(name, rows):
    enc = Encoder(vocabulary(name))
    for t in [t for _, t in rows if t] + ["q" * 900, "é" * 300 + " a" * 300]:
        t = t[:3000]
        for chunk, overlap in ((50, 8), (64, 3), (500, 100)):
            assert np.array_equal(np.concatenate(list(resynchronised(enc, t, chunk, overlap))), enc.ids(t)), (t[:40], chunk)


def test_token_counts(docs, rows, nothing):
    lib = library(WORD)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, chunk=400, overlap=40, limit=100).collect())
    want = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows)
    assert got == want and token_counts(nothing).count() == 0


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_packing(docs, rows, nothing, broadcast, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_BYTES", broadcast)
    lib = library(BYTE)
    got = packing.pack(docs, capacity=256).collect()
    assert packing.pack(nothing).count() == 0
    want = Counter()
    for i, t in rows:
        want[i, hashlib.sha256(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()).hexdigest()] += 1
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] and (r["length"] == 256 or r["piece"] == 0)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 256) + 1
    one = Counter((i, h) for (i, h), n in want.items() for _ in range(n))
    back = Counter()
    for i in {r["doc_id"] for r in got}:
        pieces = sorted((r["piece"], r["start"], r["ids"]) for r in got if r["doc_id"] == i)
        if sum(p[0] == 0 for p in pieces) == 1:
            back[i, hashlib.sha256(b"".join(p[2] for p in pieces)).hexdigest()] += 1
    assert all(one[k] == v for k, v in back.items()) and len(back) > 40


def test_best_fit_runs_equal_a_direct_packing():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = Counter(int(x) for x in rng.integers(1, 65, 300))
        free: list[int] = []
        for n in sorted(counts.elements(), reverse=True):
            fits = [i for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= n
            else:
                free.append(64 - n)
        used, placed = defaultdict(int), Counter()
        runs = packing.best_fit_runs(dict(counts), 64)
        by = defaultdict(list)
        for length, first, each, b, at in runs:
            by[length].append((first, each, b, at))
        for length, n in counts.items():
            for rank in range(n):
                first, each, b, at = [r for r in by[length] if r[0] <= rank][-1]
                assert at + ((rank - first) % each) * length <= 64 - length
                used[b + (rank - first) // each] += length
                placed[length] += 1
        assert placed == counts and max(used.values()) <= 64 and len(used) == len(free)
    with pytest.raises(ValueError):
        packing.best_fit_runs({65: 1}, 64)


def test_token_files_round_trip(spark, docs, rows, nothing, tmp_path):
    lib = library(WORD)
    files = token_files.write_token_files(docs, f"file://{tmp_path}/t", parts=3)
    got = sorted(token_files.read_token_files(spark, files).collect(), key=lambda r: r["start"])
    want = sorted(((i is not None, i or 0, t is not None, t or "") for i, t in rows))
    at = 0
    for r, (some, i, _, t) in zip(got, want, strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (i if some else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    none = token_files.write_token_files(nothing, f"file://{tmp_path}/n")
    assert none.parts == () and token_files.read_token_files(spark, none).count() == 0


def plain_simhash(t, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(docs, rows, nothing, monkeypatch):
    fps = [plain_simhash(t, 4) for _, t in rows]
    roots = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 6)
    least = defaultdict(list)
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r].append(i)
    want = Counter((i, f - (1 << 64) * (f >> 63), min(least[r], default=None)) for (i, _), f, r in zip(rows, fps, roots))
    for limit, trees in ((20_000, 1 << 18), (3, 1 << 18), (3, 10)):  # also with large shards' trees broadcast, and with large shards split in parts
        monkeypatch.setattr(simhash, "SHARD_MAX", limit)
        monkeypatch.setattr(simhash, "TREES_MAX", trees)
        assert Counter(tuple(r) for r in simhash.simhash_components(docs, 4, 6).collect()) == want
    assert simhash.simhash_components(nothing).count() == 0


def test_blocks_and_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, d, replace=False))) for d in (1, 3, 4, 5)]]))
    want = components(len(fps), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 4)
    links = simhash.linked(fps, 4)
    got = components(len(fps), lambda i, j: (i, j) in {(max(l), min(l)) for l in links})
    assert got == want


def test_near_duplicates(docs, rows, nothing):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and got[5] == 5 and got[6] == got[7] == got[8] == 6 and got[14] == 14 and got[10] == 10
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r["a"]: r["root"] for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[300] == 100 and got[529] == 500 and 0 not in got
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([("i1", ITEM), ("i2", "tiny probe"), (None, "x y z"), ("i3", None), ("i4", "..."), ("i1", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    texts = [(1, "so " + ITEM.upper().replace(" ", "; ") + " end"), (2, ITEM.rsplit(" ", 3)[0]), (3, " ".join(ITEM.split()[1:11])), (4, "a tiny probe, tiny probe!"), (5, "tiny: éprobe"), (6, None), (7, ""), (8, "x y z"), (8, "nothing"), (None, "tiny probe"), (9, "two three four five six seven eight nine ten eleven two three four five six seven eight nine ten eleven")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate(d, items).collect()}
    assert got[1, 14] == (12, ["i1"], True) and got[2, 9] == (0, [], False) and got[3, 10] == (10, ["i1"], True)
    assert got[4, 5] == (4, ["i2"], True) and got[5, 2][0] == 0 and got[6, 0][0] == got[7, 0][0] == 0 and got[8, 3] == (3, [], True) and got[8, 1][0] == 0 and got[None, 2][2] and got[9, 20][0] == 20
    assert decontaminate(docs, items.limit(0)).where("contaminated").count() == 0 and decontaminate(docs, items).count() == docs.count() and decontaminate(nothing, items).count() == 0


def test_line_dedup(docs, rows, nothing):
    got = dedup_lines(docs, min_sites=2)
    assert set(docs.columns) <= set(got.columns) and got.count() == len(rows) and dedup_lines(nothing).count() == 0
    full = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("s"), F.xxhash64("text", F.length("text")).alias("of")).collect()
    sites, first = defaultdict(set), {}
    key = lambda i: (i is not None, i or 0)
    for r in full:
        for at, line in enumerate((r["text"] or "").split("\n") if r["text"] is not None else []):
            if line.strip(" "):
                sites[line].add(r["s"])
                first[line] = min(first.get(line, ((True, 1 << 62), 0, 0)), (key(r["doc_id"]), at, r["of"]))
    want = Counter()
    for r in full:
        lines = r["text"].split("\n") if r["text"] is not None else []
        gone = [len(sites[x]) >= 2 and (key(r["doc_id"]), at, r["of"]) != first[x] if x.strip(" ") else False for at, x in enumerate(lines)]
        want[r["doc_id"], None if r["text"] is None else "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)] += 1
    assert Counter(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()) == want
    assert sum(k[3] for k in want) > 0


def test_lines_of_unlike_texts_of_one_key(spark):
    """A line that stands at the same place of two texts of one key stays in one of them."""
    rows = [(1, "menu\nalpha", "a"), (1, "menu\nbeta", "b"), (2, "menu\ngamma", "c"), (2, "menu\ngamma", "c")]
    got = sorted(r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=3).collect())
    assert got in (["alpha", "gamma", "gamma", "menu\nbeta"], ["beta", "gamma", "gamma", "menu\nalpha"])


def test_lines_of_a_very_long_text(spark):
    """The work on one text grows with its lines, not with lines times removed lines: seconds, not hours."""
    n = 100_000
    rows = [(i, "\n".join(f"line {j}" for j in range(n)) if i == 9 else "\n".join(f"line {j}" for j in range(i, n, 10)), f"s{i}") for i in range(10)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=2).collect()}
    last = [f"line {j}" for j in range(n) if j % 10 == 9]
    assert got[9] == (n, n - n // 10, "\n".join(last)) and got[0] == (n // 10, 0, rows[0][1])


@pytest.mark.parametrize("crowd, context", [(2000, 50_000), (3, 50_000), (3, 3), (0, 0)])
def test_suffix_dedup(spark, docs, rows, nothing, crowd, context, monkeypatch):
    """Also where nearly every gram and context, or every one, is crowded."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "CONTEXT_CROWD", context)
    monkeypatch.setattr(suffix_dedup, "LOOKED_AT", 64 if crowd else 1)
    rng = random.Random(1)
    rules = [(300 + i, rng.choice("ab#") * rng.randint(1, 60) + "-" * rng.randint(20, 130) + rng.choice("xy ") * rng.randint(1, 60)) for i in range(60)]
    docs, rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rules, "doc_id long, text string")), [*rows, *rules]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in dedup_spans(docs).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    starts: dict[bytes, object] = {}
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            starts.setdefault(b[p : p + 50], (i is not None, i or 0))
    want = Counter()
    for i, t in order:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if starts[b[p : p + 50]] < (i is not None, i or 0):
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(b) else 0
        want[i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    assert got == want and sum(k[2] for k in want) > 1000 and dedup_spans(nothing).count() == 0


@pytest.mark.parametrize("few", [4, 4096])
def test_deep_shallow_sorting(few, monkeypatch):
    monkeypatch.setattr(suffix_sort, "FEW", few)
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 40, 500):
        data = np.where(rng.random((n, 50)) < 0.1, rng.integers(0, 3, (n, 50)), 7).astype(np.uint8)
        if n > 3:
            data[n // 2 : n // 2 + 3] = data[0]
        order, lcp = suffix_sort.deep_shallow(data)
        got = [data[i].tobytes() for i in order]
        assert got == sorted(r.tobytes() for r in data) and sorted(order.tolist()) == list(range(n))
        for a, b, k in zip(got, got[1:], lcp[1:]):
            assert a[:k] == b[:k] and (k == 50 or a[k] != b[k])


def plain_fingerprint(text, kept):
    """As the docstring of ``imatch`` has it, with its numbers only."""
    words = sorted(set(re.findall(r"\w+", text.lower())))
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    own = [h for w, h in zip(words, hashed) if w in kept]
    pack = lambda hs: b"".join(h.to_bytes(8, "little") for h in hs)
    places = [xxhash.xxh32_intdigest(pack(own), 0) if own else xxhash.xxh32_intdigest(pack(hashed), 1) if hashed else 0]
    for d in range(3, 11):
        for e in range(6):
            turn = 0x9E3779B97F4A7C15 + 2 * (d * 6 + e)
            some = [h for h in own if ((h ^ (e + 1)) * turn % 2**64) >> (64 - d) == 0]
            places.append(xxhash.xxh32_intdigest(pack(some), d) if some else 0)
    return places


def plain_likeness(a, b):
    some = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in some) / len(some) if some else 1.0


@pytest.mark.parametrize("most", [5_000_000, 3])
def test_imatch(docs, rows, nothing, most, monkeypatch):
    """Every column against a plain version, from the first row to the last and round to the first, with the lexicon broadcast and joined."""
    monkeypatch.setattr(imatch, "LEXICON_MAX", most)
    assert imatch.edits(nothing).count() == 0 and imatch.fingerprints(nothing).count() == 0
    n = len(rows)
    df = Counter(w for _, t in rows for w in set(re.findall(r"\w+", (t or "").lower())))
    kept = {w for w, c in df.items() if max(2, 0.0005 * n) <= c <= max(2, 0.1 * n)}
    spell = lambda p: "".join(f"{x:08x}" for x in p)
    signed = lambda t: (lambda h: h - (1 << 64) * (h >> 63))(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((i is not None, i or 0, signed(t or ""), t or "") for i, t in rows), reverse=True)
    want = Counter()
    for (some, i, _, t), (_, _, _, u) in zip(order, [*order[1:], order[0]]):
        k = len(t) // 3
        new = t[: len(t) - k] + u[:k]
        own, other, after = (plain_fingerprint(x, kept) for x in (t, new, u))
        want[i if some else None, len(t), new, spell(own), spell(other), round(plain_likeness(own, other), 9), round(plain_likeness(own, after), 9)] += 1
    got = imatch.edits(docs).collect()
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == want
    assert Counter(tuple(r) for r in imatch.fingerprints(docs).collect()) == Counter((i, spell(plain_fingerprint(t or "", kept))) for i, t in rows)


def test_imatch_likeness(spark):
    """Unlike texts without a term of the lexicon are not alike, wordless ones are; a key of most rows is dealt to several ranges, and one row is its own next."""
    texts = [(7, f"only{i}") for i in range(40)] + [(1, "same same"), (2, "same"), (3, "!"), (4, "?")]
    got = imatch.edits(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sum(r["near_next"] for r in got if r["doc_id"] == 7) == 0
    near = {r["doc_id"]: r["near_next"] for r in got if r["doc_id"] < 7}
    assert near == {4: 1.0, 3: 0.0, 2: 1.0, 1: 0.0}
    one = imatch.edits(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited"] == "a b a"


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")


def test_event_folding(spark):
    log = [(1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "a"), (1, 3, "delta", 1, None, "b"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, "assistant", "c"), (1, 6, "delta", 1, None, "d"), (1, 7, "edit", 0, None, "hello"), (1, 8, "message", 2, "user", "x"), (1, 9, "noise", 2, "user", "?"), (2, 1, None, 0, "user", None), (2, 2, "regenerate", 0, None, None), (None, 1, "message", None, None, "z")]
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold_events(events(spark, log)).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "cd"), (1, 2): ("user", "x"), (None, None): (None, "z")}
    assert chat.fold_events(events(spark, [])).count() == 0


def test_chats_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\n", r"<\|<\\| <| |> <<|", "", None, "a\nb", "é🎉<|x|>", "\\n"]
    rows = [(c, t, role, texts[(c + t) % len(texts)]) for c in range(5) for t, role in enumerate(["system", "assistant", "a\\n|b\n<|im_end|>", None, "assistant"])] + [(None, 0, "assistant", "n")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.read_chats(made).collect()}
    assert len(got) == 6
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: x[1])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == [x[3] or "" for x in own if x[2] == "assistant"]
    for r in made.collect():
        for t in r["turns"]:
            assert r["formatted"][t["start"] :].startswith("<|im_start|>") and r["formatted"][t["text_start"] + t["length"] :].startswith("<|im_end|>\n")
            if t["loss"]:
                assert r["formatted"][t["text_start"] - len("<|im_start|>assistant\n") :].startswith("<|im_start|>assistant\n")
    # places are those of the whole output: moved by one, what is read is not what was said
    moved = made.withColumn("turns", F.transform("turns", lambda t: t.withField("text_start", t["text_start"] + 1)))
    back = {r["conv_id"]: r["loss"] for r in chat.read_chats(moved).collect()}
    assert all(back[c] != got[c]["loss"] for c in back)


def test_chats_take_awkward_tables(spark):
    """Nothing, columns of the same names as those of results, and one very long conversation."""
    schema = "conv_id long, turn long, role string, text string, formatted string, turns int, nth int, start int, loss int"
    empty = chat.format_chats(spark.createDataFrame([], schema))
    assert empty.count() == 0 and chat.read_chats(empty).count() == 0
    rows = [(1, t, "assistant" if t % 2 else "user", f"<|{t}|>" * (t % 5), "x", 1, 2, 3, 4) for t in range(20_000)]
    r = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, schema))).first()
    assert [t["text"] for t in r["turns"]] == [x[3] for x in rows] and r["loss"] == [x[3] for x in rows if x[2] == "assistant"]


def test_logs_of_deltas_edits_and_regenerations(spark):
    """Random logs against a fold of one event after the other."""
    rng = random.Random(8)
    rows, want = [], {}
    for c in range(60):
        live: dict[int, list] = {}
        for seq in range(rng.randint(1, 40)):
            kind, turn = rng.choice(["message", "delta", "delta", "edit", "regenerate", "noise"]), rng.randrange(4)
            role, text = rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", "<|im_end|>", "", None])
            rows.append((c, seq, kind, turn, role, text))
            if kind == "regenerate":
                live = {t: m for t, m in live.items() if t < turn}
            elif kind != "noise":
                was = live.get(turn, [None, ""])
                live[turn] = [role or was[0], (was[1] if kind == "delta" else "") + (text or "")]
        want |= {(c, t): tuple(m) for t, m in live.items()}
    rng.shuffle(rows)
    folded = chat.fold_events(events(spark, rows))
    assert {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in folded.collect()} == want
    said = {(r["conv_id"], i): (t["role"], t["text"]) for r in chat.read_chats(chat.format_chats(folded)).collect() for i, t in enumerate(r["turns"])}
    order: dict[int, int] = defaultdict(int)
    for (c, _), (role, text) in sorted(want.items()):
        assert said.pop((c, order[c])) == (role or "", text)
        order[c] += 1
    assert not said


def test_forward_backward_equals_enumeration():
    m = language.train([("un deux trois le la " * 5, "fr"), ("one two three the a " * 5, "en"), ("eins zwei drei der die " * 5, "de")])
    words = ["one", "le", "der", "two"]
    e = m.emissions(words)
    want, total = np.zeros((4, 3)), 0.0
    import itertools

    for path in itertools.product(range(3), repeat=4):
        s = np.exp(m.first[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(m.steps[a, b] for a, b in zip(path, path[1:])))
        total += s
        for i, y in enumerate(path):
            want[i, y] += s
    assert np.allclose(m.marginals([words])[0], want / total, atol=1e-5)
    long = words * 70  # over several blocks, beside short texts
    assert np.allclose(m.marginals([words, long, words])[2], want / total, atol=1e-5) and len(m.marginals([long])[0]) == 280


def test_language_id(spark, docs, rows, nothing):
    m = language.train([("the of and to in is that " * 10, "en"), ("le la et les des que qui " * 10, "fr")])
    got = language.identify_languages(docs, m).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not language.words_of(dict(rows).get(r["doc_id"]))) for r in got if r["doc_id"] in (6, 7, 8, 9))
    mixed = spark.createDataFrame([(1, "the of and that in is; et les des que la qui")], "doc_id long, text string")
    spans = language.identify_languages(mixed, m, spans=True).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "fr"] and spans[1]["start"] == 23
    assert language.identify_languages(nothing, m).count() == 0 and language.train([]).labels == []
    assert language.identify_languages(docs, language.train([])).where("lang_pred <> 'und'").count() == 0
    assert language.training_rows(docs.withColumn("lang", F.lit(None).cast("string"))) == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    got = __import__("rateline.llm.queries", fromlist=["QUERIES"]).QUERIES["op9_language_id"](spark, sf)
    both = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert both.where("lang = lang_pred").count() >= 0.95 * both.count() > 20
