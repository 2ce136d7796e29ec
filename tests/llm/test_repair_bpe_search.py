"""Conversation repair, byte-level BPE by pieces and ranked search, against brute force and the public library."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rateline.llm import conversation_repair as repair
from rateline.llm import lexical_search as search
from rateline.llm import piece_bpe as bpe

SF = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# Conversation repair


def cheapest(letters: str, inserts: int = 4) -> tuple[int, str]:
    """All ways to edit a short conversation, one by one."""
    best: list = []

    def go(i, cost, audit, roles, left):
        if best and cost > best[0][0]:
            return
        if i == len(letters):
            if re.fullmatch("(s?(ua)+)?", roles) and (not best or (cost, audit) < best[0]):
                best[:] = [(cost, audit)]
        else:
            own, more = letters[i].lower(), letters[i].isupper()
            if own != "d":
                if own in "sua":
                    go(i + 1, cost + more, audit + "K", roles + own, left)
                for r in "ua":
                    go(i + 1, cost + more + 2, audit + "R", roles + r, left)
            go(i + 1, cost + 3, audit + "D", roles, left)
        if left:
            for r in "ua":
                go(i, cost + 2, audit + "I", roles + r, left - 1)

    go(0, 0, "", "", inserts)
    return best[0]


def test_parser_equals_all_edits():
    rng = random.Random(3)
    words = [w for k in range(3) for w in itertools.product("suaxSUAXd", repeat=k)] + [rng.choices("suauauaxSUAXd", k=k) for k in (3, 3, 4) for _ in range(60)]
    for w in map("".join, words):
        assert repair.parse(w) == cheapest(w), w


def by_table(letters: str) -> tuple[int, str]:
    """Least (cost, audit) by a table of states, for long conversations."""
    inf = (10**9, "")
    states = {"n": (0, ""), "o": inf, "h": inf, "f": inf}

    def inserted(s):
        for _ in range(2):
            for a, b in (("n", "h"), ("o", "h"), ("f", "h"), ("h", "f")):
                if s[a] != inf:
                    s[b] = min(s[b], (s[a][0] + 2, s[a][1] + "I"))
        return s

    states = inserted(states)
    for x in letters:
        new = {k: (c + 3, a + "D") if (c, a) != inf else inf for k, (c, a) in states.items()}
        if x != "d":
            for a, b, r in (("n", "o", "s"), ("n", "h", "u"), ("o", "h", "u"), ("f", "h", "u"), ("h", "f", "a")):
                if states[a] != inf and (x.lower() == r or r != "s"):
                    kept = x.lower() == r
                    new[b] = min(new[b], (states[a][0] + 2 * (not kept) + x.isupper(), states[a][1] + ("K" if kept else "R")))
        states = inserted(new)
    return min(states["n"], states["f"])


def test_long_conversations():
    rng = random.Random(4)
    for n in (50, 400, 3000):
        w = "".join(rng.choices("uauauasxUASXd", k=n))
        assert repair.parse(w) == by_table(w)
    for w in ("u" * 500, "d" * 300, "s" * 50, "ua" * 400):
        assert repair.parse(w) == by_table(w)


def plain_repair(rows):
    """Digest rows of damaged conversations, in plain Python. ``rows``: (conv_id, turn, role, text)."""
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = kept[conv]
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        if fate:
            own.extend([(turn is not None, turn, role, text)] * (2 if fate == 3 else 1))
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[0]]
        counts, letters, seen = Counter(), "", set()
        for _, _, role, text in own:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = by_table(letters) if own else (0, "")
        said, at, role = [], 0, "u"
        for e in audit:
            _, _, r, t = own[at] if e != "I" else (0, 0, "", "")
            at += e != "I"
            if e == "D":
                continue
            if e in "RI":
                r = {"u": "user", "a": "assistant"}[role]
            said.append(f"{r}:{t}")
            role = "u" if r[:1] in ("s", "a") else "a"
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(said)))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_repair_of_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repair.op11_conversation_repair(spark, SF)
    assert dict(got.dtypes) == {"conv_id": "bigint", "audit": "string", "repaired_sha256": "string"} | {c: "bigint" for c in COLUMNS[:6]}
    assert results(got) == plain_repair(rows)


@pytest.fixture()
def odd_conversations(spark, tmp_path):
    rng = random.Random(9)
    text = lambda: rng.choice(["Yes.", "no", "", None, "  \n", "x" * 200_000 + "!", "Why?  ", "é", "done. \x1c", "Tab\t.\t"])
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", None, "tool", ""]), text()) for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(1500)] + [(101, 5, "user", "same.")] * 40
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place long, letter string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path), rows


def test_repair_of_nulls_ties_and_crowds(spark, odd_conversations):
    at, rows = odd_conversations
    assert results(repair.op11_conversation_repair(spark, at)) == plain_repair(rows)


def test_repair_returns_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi?"), (1, 3, "user", "Hi?")], "conv_id long, turn long, role string, text string")
    row = repair.repair(turns).first()
    assert (row["cost"], row["audit"]) == (7, "KIKKDI")
    assert [(e["role"], e["text"]) for e in row["edits"] if e["edit"] != "D"] == [("system", "Be kind."), ("user", ""), ("assistant", "Hello."), ("user", "Hi?"), ("assistant", "")]
    assert repair.repair(turns.limit(0)).count() == 0


# Byte-level BPE by pieces


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = dict(bpe.read_ranks(bpe.vocabulary("byte_bpe_multi_50k.tiktoken")))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_library(library):
    model, rng = bpe.PieceBPE(bpe.vocabulary("byte_bpe_multi_50k.tiktoken")), random.Random(1)
    pool = "abc XYZ 'sre'll\n\t\r  \x00\x1c\x1d\x85\xa0é日本語\U0001f389ß0123٣½!?.,<|>​  ﻿́ñ_-#▁⁇㈻0\U0003fc3f࢏"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "\n" * 999, "x" * 50_000, "ab" * 30_000, " a" * 9_999, "<|endoftext|>"]
    for t in texts:
        ids = np.frombuffer(model.packed(t), "<i4")
        assert ids.tolist() == library.encode_ordinary(t), t[:50]
        assert model.text_of(ids) == t.encode()


def test_another_pattern(library):
    import tiktoken

    ranks = dict(bpe.read_ranks(bpe.vocabulary("byte_bpe_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=r"\w+|\W", mergeable_ranks=ranks, special_tokens={})
    model = bpe.PieceBPE(bpe.vocabulary("byte_bpe_50k.tiktoken"), r"\w+|\W")
    for t in ("Hello there, you", "a  b\n\nc", "日本語 x_y"):
        assert np.frombuffer(model.packed(t), "<i4").tolist() == own.encode_ordinary(t)


def test_model_file_is_whole(tmp_path):
    """What is serialised loads as any model of the library does; a vocabulary without a byte is refused."""
    import sentencepiece

    ranks = [(bytes([b]), b) for b in range(256)] + [(b"ab", 300), (b"abc", 301), (b" a", 302)]
    (tmp_path / "own.model").write_bytes(bpe.serialise(ranks))
    lib = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "own.model"))
    assert lib.get_piece_size() == 260 and lib.encode("abcab") == [257, 256] and lib.unk_id() == 259
    (tmp_path / "ranks").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="not every byte"):
        bpe.read_ranks(str(tmp_path / "ranks"))


def test_encode_and_decode_rows(spark, docs, rows, nothing, library):
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"] and bytes(r["decoded"])) for r in bpe.decode(bpe.encode(docs)).collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    kept = bpe.encode(docs.withColumnRenamed("g", "ids"))
    assert set(kept.columns) == {"ids", *docs.columns} - {"text", "g"}
    assert bpe.decode(bpe.encode(nothing)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(odd).collect()} == {1: None, 2: b""}


def test_op12(spark, library):
    own = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.op12_piece_bpe(spark, SF).collect()}
    assert got == {i: (len(ids := library.encode_ordinary(t)), sha(",".join(map(str, ids))), sha(t)) for i, t in own.items()}


# Ranked search


def plain_search(docs, items, k=10):
    """Every score of every document for every item."""
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := cut(t))]
    n, length = len(held), sum(s for _, _, s in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = set()
    for item, text in set(items):
        scores = []
        for i, c, size in held:
            m = 100 - 90 + (90 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        scores.sort(key=lambda x: x[:3])
        out |= {(item, rank, x[3], -x[0]) for rank, x in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("pairs, block", [(200_000, 8192), (40, 16), (7, 3)])
def test_search_equals_all_scores(spark, docs, rows, monkeypatch, pairs, block):
    monkeypatch.setattr(search, "PAIRS", pairs)
    monkeypatch.setattr(search, "BLOCK", block)
    rng = random.Random(2)
    words = sorted({w for _, t in rows for w in (t or "").split()})
    items = [(j, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for j in range(12)] + [(12, "menu home"), (13, None), (14, "nosuchterm"), (14, "A b c D"), (None, "Ünïcödé short"), (15, "ünïcödé"), (12, "menu home"), (16, "... !")]
    table = spark.createDataFrame([(i, t, 7, 8) for i, t in items], "item_id long, text string, rank long, score long")
    got = search.search(docs, table)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_search(rows, items))


def test_search_of_copies_and_crowds(spark, monkeypatch):
    """Thousands of copies and near copies of one text: ranks are those of the least ids, and few candidates are looked up."""
    monkeypatch.setattr(search, "BLOCK", 64)
    rows = [(5000 - i, "the hot passage about rivers and stones") for i in range(2000)]
    rows += [(9000 + i, f"the hot passage about rivers and stones number{i}") for i in range(1500)]
    rows += [(20_000 + i, f"the word{i % 50} and the word{i % 7}") for i in range(1500)]
    items = [(1, "hot rivers and stones"), (2, "the"), (3, "word3 word4 the number17"), (4, "the and number5")]
    got = search.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == plain_search(rows, items)


def test_search_of_nothing(spark, nothing, docs):
    items = spark.createDataFrame([(1, "menu")], "item_id long, text string")
    assert search.search(nothing, items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs, spark.createDataFrame([(1, None)], "item_id long, text string")).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_op13(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {tuple(r) for r in search.op13_lexical_search(spark, SF).collect()} == plain_search(docs, items)
