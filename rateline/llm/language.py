"""Language identification by a linear-chain conditional random field.

Words are labelled by forward-backward over emissions (affixes, character
n-grams, a lexicon) and learned transitions; a document's language is the one
with the most words by their marginals. The field is trained here, on a bounded
sample: ``TRAIN_DOCS`` documents of each language, the first ``TRAIN_CHARS`` of
each. Training mixes whole runs of one language with sequences spliced from
several, so transitions are those of code-switched text.

Long texts cost no more steps than short ones: blocks of words are turned into
transfer matrices side by side, blocks are joined in order, and marginals are
filled in within all blocks at once. That is exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import small_batches, table

#: Bounds of the training sample, for each language.
TRAIN_DOCS, TRAIN_CHARS = 150, 20_000
HASH_BITS, EPOCHS, RUN, BATCH, SEED = 16, 4, 32, 64, 7
#: A word is of the lexicon if so many training documents have it.
LEXICON_DOCS = 3
BLOCK, BATCH_WORDS, CACHE_WORDS = 64, 400_000, 300_000
#: N-grams whose buckets a worker keeps, and new words whose features are summed together.
CACHE_GRAMS, NEW_WORDS = 500_000, 20_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


class Buckets(dict):
    """The bucket of each n-gram seen so far: few n-grams make up all words, so most are hashed once."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= CACHE_GRAMS:
            self.clear()
        at = self[gram] = xxhash.xxh32_intdigest(gram) & ((1 << HASH_BITS) - 1)
        return at


@dataclass
class Field:
    """A trained field: weights of hashed features for each label, transitions, and the lexicon."""

    labels: list[str]
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray
    lexicon: frozenset[str]
    cache: dict[str, int] = field(default_factory=dict)
    buckets: Buckets = field(default_factory=Buckets)
    #: Scores of the words in ``cache``, by their numbers; there is room for more.
    scores: np.ndarray | None = None

    def features(self, word: str) -> list[int]:
        """Buckets of a word's features: prefixes and suffixes of 1 to 3, n-grams of 2 and 3 with the word's ends, the word itself if it is of the lexicon, and a constant."""
        w = f"^{word}$"
        found = [w[i : i + 2] for i in range(len(w) - 1)]
        found += [w[i : i + 3] for i in range(len(w) - 2)]
        found += ["p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:], ""]
        if word in self.lexicon:
            found.append("=" + word)
        return list(map(self.buckets.__getitem__, dict.fromkeys(found)))

    def _score(self, words: list[str]) -> None:
        """Distinct words that are not in the cache, into it; their weights are summed together."""
        used = len(self.cache)
        if self.scores is None or used + len(words) > len(self.scores):
            room = np.empty((2 * (used + len(words)), len(self.labels)), np.float32)
            if used:
                room[:used] = self.scores[:used]
            self.scores = room
        for lo in range(0, len(words), NEW_WORDS):
            own = words[lo : lo + NEW_WORDS]
            found = list(map(self.features, own))
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
            self.scores[used : used + len(own)] = np.add.reduceat(self.weights[flat], np.cumsum(size) - size, axis=0)
            self.cache.update(zip(own, range(used, used + len(own))))
            used += len(own)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each label."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        at = list(map(self.cache.get, words))
        if None in at:
            self._score(list(dict.fromkeys(w for w, a in zip(words, at) if a is None)))
            at = list(map(self.cache.__getitem__, words))
        return self.scores[np.array(at)]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Each word's probabilities of the labels, by forward-backward over each whole text (none may be empty)."""
        n, k = len(self.labels), BLOCK
        sizes = np.array([len(t) for t in texts])
        blocks = -(-sizes // k)
        ends = np.cumsum(blocks)
        starts = ends - blocks
        e = self.emissions([w for t in texts for w in t])
        e = np.exp(e - e.max(1, keepdims=True)).astype(np.float64) + 1e-12
        place = np.concatenate([np.arange(s) + b * k for s, b in zip(sizes, starts)])
        emit = np.ones((ends[-1] * k, n))
        emit[place] = e
        real = np.zeros(ends[-1] * k, bool)
        real[place] = True
        emit, real = emit.reshape(-1, k, n), real.reshape(-1, k)
        step, first, same = np.exp(self.steps), np.exp(self.first), np.eye(n)

        def move(j: int) -> np.ndarray:
            m = np.where(real[:, j, None, None], step[None], same[None])
            if j == 0:
                m[starts] = np.broadcast_to(first, (n, n))
            return m * emit[:, j, None, :]

        whole = np.broadcast_to(same, (ends[-1], n, n)).copy()
        for j in range(k):
            whole = whole @ move(j)
            whole /= whole.sum((1, 2), keepdims=True)
        ahead, behind = np.full((ends[-1], n), 1 / n), np.ones((ends[-1], n))
        order = np.argsort(-blocks, kind="stable")
        for j in range(1, int(blocks.max())):
            own = order[: int((blocks > j).sum())]
            at = starts[own] + j
            a = np.einsum("bi,bij->bj", ahead[at - 1], whole[at - 1])
            ahead[at] = a / a.sum(1, keepdims=True)
            at = ends[own] - 1 - j
            b = np.einsum("bij,bj->bi", whole[at + 1], behind[at + 1])
            behind[at] = b / b.sum(1, keepdims=True)
        alpha, beta = np.empty_like(emit), np.empty_like(emit)
        a, b = ahead, behind
        for j in range(k):
            a = np.einsum("bi,bij->bj", a, move(j))
            a /= a.sum(1, keepdims=True)
            alpha[:, j] = a
        for j in range(k - 1, -1, -1):
            beta[:, j] = b
            b = np.einsum("bij,bj->bi", move(j), b)
            b /= b.sum(1, keepdims=True)
        p = (alpha * beta).reshape(-1, n)[place]
        p /= p.sum(1, keepdims=True)
        return np.split(p, np.cumsum(sizes)[:-1])


def train(samples: list[tuple[str, str]], seed: int = SEED) -> Field:
    """A field from (text, label) pairs, by stochastic gradient ascent of the likelihood with a step size for each weight."""
    rng = np.random.default_rng(seed)
    pairs = [(words_of(t[:TRAIN_CHARS]), label) for t, label in samples]
    pairs = [(w, label) for w, label in pairs if w]
    labels = sorted({label for _, label in pairs})
    n = len(labels)
    seen = Counter(w for words, _ in pairs for w in set(words))
    out = Field(labels, np.zeros((1 << HASH_BITS, max(n, 1)), np.float32), np.zeros((n, n)), np.zeros(n), frozenset(w for w, c in seen.items() if c >= LEXICON_DOCS))
    if n == 0:
        return out
    of, buckets = {}, []
    for words, _ in pairs:
        for w in words:
            if w not in of:
                of[w] = len(buckets)
                buckets.append(np.array(out.features(w)))
    runs: list[tuple[np.ndarray, np.ndarray]] = []
    docs = [(np.array([of[w] for w in words]), labels.index(label)) for words, label in pairs]
    for ids, y in docs:
        runs += [(ids[i : i + RUN], np.full(len(ids[i : i + RUN]), y)) for i in range(0, len(ids), RUN)]
    for _ in range(len(runs) // 3):  # code-switched
        ids, ys = [], []
        while len(ids) < RUN:
            d, y = docs[rng.integers(len(docs))]
            m = int(rng.integers(4, 17))
            at = int(rng.integers(max(1, len(d) - m)))
            ids += d[at : at + m].tolist()
            ys += [y] * len(d[at : at + m])
        runs.append((np.array(ids[:RUN]), np.array(ys[:RUN])))
    sums = np.full_like(out.weights, 1e-2), np.full_like(out.steps, 1e-2), np.full_like(out.first, 1e-2)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(runs))
        for lo in range(0, len(order), BATCH):
            own = [runs[i] for i in order[lo : lo + BATCH]]
            b = len(own)
            x = np.full((b, RUN), -1)
            y = np.zeros((b, RUN), int)
            for i, (ids, ys) in enumerate(own):
                x[i, : len(ids)], y[i, : len(ids)] = ids, ys
            real = x >= 0
            feats = [buckets[w] for w in x[real]]
            flat, size = np.concatenate(feats), np.array([len(f) for f in feats])
            e = np.zeros((b, RUN, n))
            e[real] = np.add.reduceat(out.weights[flat], np.cumsum(size) - size, axis=0)
            p, both = _likelihood(e, real, out.steps, out.first)
            gold = np.eye(n)[y]
            g = (gold - p)[real]
            rows = np.repeat(g, size, axis=0)
            grads = np.stack([np.bincount(flat, rows[:, j], 1 << HASH_BITS) for j in range(n)], 1).astype(np.float32), np.zeros((n, n)), (gold - p)[:, 0].sum(0)
            follow = real[:, 1:]
            np.add.at(grads[1], (y[:, :-1][follow], y[:, 1:][follow]), 1.0)
            grads = grads[0], grads[1] - both, grads[2]
            for w, grad, s in zip((out.weights, out.steps, out.first), grads, sums):
                s += grad * grad
                w += 0.1 * grad / np.sqrt(s)
    return out


def _likelihood(e: np.ndarray, real: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word, and expected counts of each transition, of a batch of short runs."""
    b, t, n = e.shape
    m, start = np.exp(steps), np.exp(first)
    x = np.exp(e - e.max(2, keepdims=True))
    alpha, beta = np.zeros_like(x), np.ones_like(x)
    a = start * x[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for j in range(1, t):
        a = (alpha[:, j - 1] @ m) * x[:, j]
        alpha[:, j] = np.where(real[:, j, None], a / a.sum(1, keepdims=True), alpha[:, j - 1])
    for j in range(t - 2, -1, -1):
        c = (x[:, j + 1] * beta[:, j + 1]) @ m.T
        beta[:, j] = np.where(real[:, j + 1, None], c / c.sum(1, keepdims=True), 1.0)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    both = np.zeros((n, n))
    for j in range(1, t):
        q = alpha[:, j - 1, :, None] * m * (x[:, j] * beta[:, j])[:, None, :]
        q /= q.sum((1, 2), keepdims=True)
        both += q[real[:, j]].sum(0)
    return p, both


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """The documents of each language that have the least hashes of their key, ``TRAIN_DOCS`` at most; rows without a text or a language are passed over. The texts of few more rows than that are read."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row a language
    if not n:
        return []
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, 2.0 * TRAIN_DOCS / v + 20 / v))])
    order = F.xxhash64(key)
    some = rows.where(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col(lang)))
    nth = F.row_number().over(Window.partitionBy(lang).orderBy(order, text))
    picked = some.select(F.substring(text, 1, TRAIN_CHARS).alias("t"), F.col(lang).alias("l"), nth.alias("nth")).where(F.col("nth") <= TRAIN_DOCS)
    return sorted((r["t"], r["l"]) for r in picked.collect())


def identify_languages(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text", spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` (or the columns ``keep`` in its place), ``lang_pred, score`` of each row, and with ``spans`` the runs of words of one language, in code points: ``spans array<struct<start, end, lang>>``.

    ``score`` is the mean marginal of the language over all words. Null texts,
    and those without a letter (or without a trained label), are ``und`` with
    score 0. No other columns are read. Repeated rows stay; an empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    own = list(keep) or [key]
    if clash := {"lang_pred", "score", "spans"} & set(own):
        raise ValueError(f"keep: {clash} are results")
    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double")
    if spans:
        schema = schema.add("spans", DataType.fromDDL("array<struct<start:long,end:long,lang:string>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(len(own)).to_pylist()
            words = [words_of(t) if m.labels else [] for t in texts]
            langs, scores, runs = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            todo = [i for i, w in enumerate(words) if w]
            while todo:
                size, upto = 0, 0
                while upto < len(todo) and (size == 0 or size + len(words[todo[upto]]) <= BATCH_WORDS):
                    size += len(words[todo[upto]])
                    upto += 1
                some, todo = todo[:upto], todo[upto:]
                for i, p in zip(some, m.marginals([words[i] for i in some])):
                    mean = p.mean(0)
                    best = int(mean.argmax())
                    langs[i], scores[i] = m.labels[best], float(min(1.0, mean[best]))
                    if spans:
                        runs[i] = _runs(texts[i], p.argmax(1), m.labels)
            cols = [*batch.columns[: len(own)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                cols.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*own, F.col(text).alias("_text")).mapInArrow(run, schema)


def _runs(text: str, best: np.ndarray, labels: list[str]) -> list[dict]:
    """Places are those of the text in lower case where that is as long as the text, as it nearly always is; else of words in their order."""
    low = text.lower() if len(text.lower()) == len(text) else text
    found = [m for m in _WORD.finditer(low) if any(map(str.isalpha, m[0]))]
    out: list[dict] = []
    for m, y in zip(found, best):
        if out and out[-1]["lang"] == labels[y]:
            out[-1]["end"] = m.end()
        else:
            out.append({"start": m.start(), "end": m.end(), "lang": labels[y]})
    return out


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for every document by a field that learns from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(training_rows(docs.where(F.col("doc_id").isNotNull() & ~held_out())))
    return identify_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
