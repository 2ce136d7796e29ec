"""Scores of words, ids of strung pieces and classes of anchors, each against a plain way."""

import numpy as np
import pytest

from rateline.llm import bpe as B
from rateline.llm import language as L
from rateline.llm import piece_bpe as P
from rateline.llm import suffix_dedup


def test_new_words_are_scored_together_and_each_gram_is_hashed_once(monkeypatch):
    rng = np.random.default_rng(3)
    m = L.Field(["a", "b", "c"], rng.normal(size=(1 << L.HASH_BITS, 3)).astype(np.float32), np.zeros((3, 3)), np.zeros(3), frozenset({"banana"}))
    asked, plain = [], L.xxhash.xxh32_intdigest
    monkeypatch.setattr(L.xxhash, "xxh32_intdigest", lambda g: asked.append(g) or plain(g))
    monkeypatch.setattr(L, "CACHE_WORDS", 6)
    monkeypatch.setattr(L, "NEW_WORDS", 2)
    words = ["banana", "band", "é", "banana", "bandana", "an", "and", "ban", "nab"]
    for own in (words, words[::-1], words[:2], ["zebra", *words]):
        got = m.emissions(own)
        assert np.allclose(got, [m.weights[m.features(w)].sum(0) for w in own], atol=1e-5)
    assert len(asked) == len(set(asked))
    assert len(m.features("banana")) == len(dict.fromkeys(["^b", "ba", "an", "na", "a$", "^ba", "ban", "ana", "nan", "na$", "pb", "pba", "pban", "sa", "sna", "sana", "", "=banana"]))


def test_strung_pieces_are_parted_by_the_bytes_of_tokens():
    e = B.Encoder(B.vocabulary("byte_bpe_50k.json"))
    special = next(iter(e.lib.get_added_tokens_decoder().values())).content
    assert e.bytes_of is not None
    for text in ("Zürich ß naïve 你好 🙂🙂 end", f"a {special} b{special}c {special}", "one  two\n\tthree one two", "ǅ x y é é ﬁ"):
        for _ in range(2):  # the second time from the cache
            assert e.ids(text).tolist() == e.lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_encoded_together_ask_the_model_for_each_word_once(name, monkeypatch):
    e, plain = B.Encoder(B.vocabulary(name)), B.Encoder(B.vocabulary(name), cut=False)
    texts = ["Zürich lies there, naïve Zürich lies.", "", " there\n\tlies Zürich, it's <|endoftext|> 12 b", "naïve\nnaïve### ", "你好 é é lies, naïve", "ſ Ñ. don't' 'LL \r\n x"]
    want = [plain.packed(t) for t in texts]
    for together in (B.TOGETHER, 20):
        monkeypatch.setattr(B, "TOGETHER", together)
        assert e.packed_all(texts) == want
    asked = []

    class Matcher:
        def encode_batch_fast(self, texts, add_special_tokens, lib=e.matcher):
            asked.extend(w for t in texts for w in t.split("\n"))
            return lib.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    e = B.Encoder(B.vocabulary(name))
    e.matcher, e.lib = Matcher(), None  # words and punctuation do not need the rest of the library
    assert e.packed_all([" there, naïve lies", " naïve. there lies### lies,"] * 9) == [plain.packed(t) for t in (" there, naïve lies", " naïve. there lies### lies,")] * 9
    assert len(asked) == len(set(asked)) == 6


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_numbers_white_space_and_joined_words_need_no_search_for_matches(name, monkeypatch):
    """Only an apostrophe before a letter, and characters of no known class, go to the library as texts."""
    plain = B.Encoder(B.vocabulary(name), cut=False)
    texts = ["On 12.5.2024,  a-b (x_y)\n\n\tz9 Größe/größe", "", " \n", "x\t7\r\n", "3 \n4 ### 'quoted' '12"]
    want = [plain.packed(t) for t in texts]
    e, lib = B.Encoder(B.vocabulary(name)), plain.lib
    asked = []

    class Library:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return lib.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    e.lib = Library()
    assert e.packed_all(texts) == want and asked == [" 'quoted"]
    other = "it's a\u0301 x"
    assert e.packed_all([other, *texts]) == [plain.packed(other), *want] and asked == [" 'quoted", "'s", " a\u0301"]
    monkeypatch.setattr(B, "CACHE_PIECES", 3)
    for _ in range(2):
        assert e.packed_all(texts) == want and len(e.kept) == len(e.kept_ids) <= 3


def test_pre_tokens_of_a_rank_file_are_matched_and_decoded_together(monkeypatch):
    """Only what may be several matches is searched for them, and the library is asked for each word once."""
    m = P.PieceBPE(B.vocabulary("byte_bpe_multi_50k.tiktoken"))
    texts = ["Xqzvj 12.5,  Xqzvj-Größzqx\n\n\tXqzvj", "", " \n", "it's Xqzvj a\u0301"] * 2
    want = [m._split([t])[0].as_py() for t in texts]
    searched, asked, lib = [], [], m.lib

    class Library:
        def encode(self, words, num_threads):
            asked.extend(words)
            return lib.encode(words, num_threads=num_threads)

    m.lib = Library()
    monkeypatch.setattr(m, "split", lambda t, f=m.split: searched.append(t) or f(t))
    assert m.packed_all(texts) == want and searched == ["'s", " a\u0301"] and len(asked) == len(set(asked))
    ids = np.frombuffer(b"".join(want), "<i4")
    flat, at = m.texts_of(ids, np.append(0, np.cumsum([len(w) // 4 for w in want])))
    assert [flat[x:y].tobytes().decode() for x, y in zip(at, at[1:])] == texts
    for wrong in (-1, 1 << 20):
        with pytest.raises(IndexError):
            m.text_of(np.array([wrong], "<i4"))


def test_batches_are_encoded_in_groups_and_given_back_as_they_were(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(B, "TOGETHER", 30)
    batches = [pa.RecordBatch.from_pydict({"i": [i, i + 1], "t": [t, None]}, schema=pa.schema([("i", pa.int64()), ("t", pa.string())])) for i, t in enumerate(["a b", "c" * 40, "", "d"])] + [pa.RecordBatch.from_pydict({"i": pa.array([], pa.int64()), "t": pa.array([], pa.string())})]
    calls = []
    got = list(B.packed_batches(lambda texts: calls.append(texts) or [t.encode() for t in texts], iter(batches), 1))
    assert [b.to_pydict() for b, _ in got] == [b.to_pydict() for b in batches]
    assert [ids for _, ids in got] == [[b"a b", b""], [b"c" * 40, b""], [b"", b""], [b"d", b""], []] and len(calls) == 2


def test_anchors_of_a_task_are_classed_whatever_the_order_of_documents(spark):
    passage = "a passage of well over fifty bytes that stands in several documents, as it is"
    docs = [(9, "x" * 20 + passage), (2, passage + "y" * 9), (5, passage), (7, "nothing of it here, but long enough to have an anchor of its own")]
    for own in (docs, docs[::-1]):
        rows = spark.createDataFrame(own, "doc long, text string").coalesce(1)
        found = suffix_dedup._found(rows).collect()
        assert {r["doc"] for r in found if r["c"] is not None} == {9, 2, 7} or {r["doc"] for r in found if r["c"] is not None} == {9, 2, 5, 7}
        classes = [r["c"] for r in found if r["c"] is not None]
        assert len(classes) == len(set(classes))
        got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup_spans(rows.withColumnRenamed("doc", "doc_id")).collect()}
        assert got == {2: 0, 5: len(passage), 7: 0, 9: len(passage)}


def test_anchors_of_joined_texts_are_those_of_each_text(monkeypatch):
    rng = np.random.default_rng(8)
    data = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (50, 51, 300, 84, 1000, 50)] + [b"-" * 120, bytes(60), bytes(rng.integers(0, 256, 400, dtype=np.uint8))]
    for piece in (suffix_dedup.PIECE, 70):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        flat, start, size = suffix_dedup._joined(data)
        whole = np.zeros(len(flat) - suffix_dedup.SPAN + 1, bool)
        for x, n in zip(start, size):
            whole[x : x + n - suffix_dedup.SPAN + 1] = True
        at, g = suffix_dedup.anchors(flat, whole)
        which = np.searchsorted(start, at, "right") - 1
        for i, own in enumerate(data):
            places, hashes = suffix_dedup.anchors(np.frombuffer(own, np.uint8))
            assert np.array_equal(at[which == i] - start[i], places) and np.array_equal(g[which == i], hashes)
            rows, left, right = suffix_dedup._around(flat, start[which][which == i], size[which][which == i], places)
            padded = bytes(suffix_dedup.BEFORE) + own + bytes(suffix_dedup.SPAN)
            assert [r.tobytes() for r in rows] == [padded[p : p + suffix_dedup.WIDE] for p in places]
            assert left.tolist() == [min(p, suffix_dedup.BEFORE) for p in places] and right.tolist() == [min(len(own) - p, suffix_dedup.SPAN) for p in places]
            assert suffix_dedup._rows(suffix_dedup._binary(rows)).tolist() == rows.tolist()
