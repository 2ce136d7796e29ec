"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Nothing is trained: each token of the rank file is one piece of a BPE model in
sentencepiece's own file format. A piece has one visible character for each
byte, and its score is its negative rank, so the library, which always joins
the neighbours of the highest score, joins those of the least rank. The
normaliser is the identity: nothing is put before a text, collapsed or escaped.

A text is cut into pre-tokens by a pattern and each is encoded by itself. A
pre-token that is a token as it stands is that token, as in the library the
rank files are made for. Decoding goes from ids to pieces, and from their
characters back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ByteLetters, Words, binaries, byte_characters, in_order, packed_batches, parts_of, single, vocabulary
from .common import small_batches, table

#: A character that no byte is mapped to: the piece that the format demands for what is unknown, which no text can hold.
UNKNOWN = "⁇"
#: Fixed values of the file format: field numbers and kinds of a model's parts.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND, KIND_UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, TYPE_BPE = 3, 4, 40, 41, 42, 43, 2
NAME, DUMMY_PREFIX, FEWER_SPACES, ESCAPED_SPACES = 1, 3, 4, 5
#: Letters and digits that Unicode has had since version 17 only, and the library of the rank files does not know.
NEWER = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
#: The pattern that the cuts of ``Words`` hold for.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A character that is no letter, digit or white space, in their place while a text is cut.
NO_LETTER = "\uffff"
_CACHED: dict[tuple[str, str | None], "PieceBPE"] = {}


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, rank) of a rank file, in the order of rank."""
    with open(path, "rb") as f:
        found = sorted(((base64.b64decode(token), int(rank)) for token, rank in (line.split() for line in f if line.strip())), key=lambda x: x[1])
    if not {bytes([b]) for b in range(256)} <= {token for token, _ in found}:
        raise ValueError(f"{path}: not every byte is a token, so not every text can be encoded")
    return found


def _number(n: int) -> bytes:
    """A variable-length integer of the format; negative ones as 64 bits."""
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes((*out, n))


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value)


def serialise(ranks: list[tuple[bytes, int]]) -> bytes:
    """A sentencepiece BPE model of these tokens; piece i is the i-th of them, and one behind all is the unknown one.

    Ranks up to 2^24 are exact as scores. The result is a whole ``.model`` file.
    """
    if ranks and ranks[-1][1] >= 1 << 24:
        raise ValueError("ranks from 2^24 on are no exact scores")
    letters = byte_characters()
    piece = lambda token, rank: _field(PIECES, _field(PIECE_TEXT, "".join(map(letters.__getitem__, token)).encode()) + _field(PIECE_SCORE, -float(rank)))
    unknown = _field(PIECES, _field(PIECE_TEXT, UNKNOWN.encode()) + _field(PIECE_SCORE, 0.0) + _field(PIECE_KIND, KIND_UNKNOWN))
    trainer = [(MODEL_TYPE, TYPE_BPE), (VOCAB_SIZE, len(ranks) + 1), (UNK_ID, len(ranks)), (BOS_ID, -1), (EOS_ID, -1), (PAD_ID, -1)]
    normalizer = [(NAME, b"identity"), (DUMMY_PREFIX, 0), (FEWER_SPACES, 0), (ESCAPED_SPACES, 0)]
    return b"".join([*(piece(*r) for r in ranks), unknown, _field(TRAINER, b"".join(_field(*x) for x in trainer)), _field(NORMALIZER, b"".join(_field(*x) for x in normalizer))])


class PieceBPE(Words):
    """``packed(text)``: ids as little-endian 32-bit integers; ``text_of(ids)``: the bytes of them."""

    def __init__(self, path: str, pattern: str | None = None):
        import regex
        import sentencepiece

        super().__init__()
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.cuts = pattern == CUT
        ranks = read_ranks(path)
        letters = byte_characters()
        self.pattern = regex.compile(pattern)
        self.newer = re.compile("[" + "".join("-".join(chr(int(c, 16)) for c in span.split("-")) for span in NEWER.split()) + "]")
        self.letters = ByteLetters(letters, True)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.rank = np.array([r for _, r in ranks], "<i4")
        back = {c: b for b, c in enumerate(letters)}
        held = {r: bytes(map(back.__getitem__, self.lib.id_to_piece(i))) for i, r in enumerate(self.rank.tolist())}
        # the bytes of each rank, null where no token has it; all tokens with their packed ranks
        self.tokens = pa.array([held.get(r) for r in range(ranks[-1][1] + 1)], pa.binary())
        self.whole = pa.array([token for token, _ in ranks], pa.binary())
        self.whole_ids = binaries(self.rank.view(np.uint8), 4 * np.arange(len(ranks) + 1))

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii() or not self.newer.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.newer.sub(NO_LETTER, text))]

    def _matches(self, found: pa.Array) -> pa.Array:
        """The packed ids of pre-tokens: those that are no tokens themselves go to the library in one call."""
        at = pc.index_in(found, value_set=self.whole)
        token = at.is_valid().to_numpy(zero_copy_only=False)
        text, _ = self.letters.strung(*parts_of(found.filter(pa.array(~token))))
        ids: list[list[int]] = self.lib.encode(text.split("\n"), num_threads=1) if text else []
        flat = self.rank[np.fromiter(chain.from_iterable(ids), np.int64)]
        made = binaries(flat, 4 * np.cumsum([0, *map(len, ids)]))
        return in_order(token, self.whole_ids.take(at.drop_null()), made)

    def _new(self, pieces: pa.Array) -> pa.Array:
        one = single(*parts_of(pieces))
        texts = pieces.filter(pa.array(~one)).to_pylist()
        return in_order(one, self._matches(pieces.filter(pa.array(one)).cast(pa.binary())), self._split(texts) if texts else pa.array([], pa.binary()))

    def _split(self, texts: list[str]) -> pa.Array:
        """The packed ids of texts of several pre-tokens."""
        words = [[w.encode() for w in self.split(t)] for t in texts]
        told = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
        flat, bounds = parts_of(self._matches(told.dictionary).take(told.indices))
        return binaries(flat, bounds[np.cumsum([0, *map(len, words)])])

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        return super().packed_all(texts) if self.cuts else [i.as_py() for i in self._split(texts)]

    def packed(self, text: str) -> bytes:
        return self.packed_all([text])[0]

    def texts_of(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those from each of ``bounds`` on begin."""
        found = self.tokens.take(pa.array(ids))
        if found.null_count:
            raise ValueError("an id is no rank")
        flat, at = parts_of(found)
        return flat, at[bounds]

    def text_of(self, ids: np.ndarray) -> bytes:
        return self.texts_of(ids, np.zeros(1, np.int64))[0].tobytes()


def piece_bpe(path: str, pattern: str | None = None) -> PieceBPE:
    """One model a worker, file and pattern."""
    if (path, pattern) not in _CACHED:
        _CACHED[path, pattern] = PieceBPE(path, pattern)
    return _CACHED[path, pattern]


def encode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", text: str = "text", ids: str = "ids", pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of ``text``.

    One narrow stage, a row for each row, in no set order; repeated rows are
    kept, an empty table gives an empty table, a column named as ``ids`` is
    replaced. Null texts count as empty: no ids. Strings of special tokens are
    text. The rank file is named, or a path that every worker can open; the
    pattern is that of the public files unless another is given. A document's
    ids are one value of Spark (2^29 at most).
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe(vocabulary(ranks), pattern)
        for batch, own in packed_batches(model.packed_all, batches, len(keep)):
            ends = np.cumsum([0, *(len(i) // 4 for i in own)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(own), "<i4")))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), arrays], names=[*keep, ids])

    return docs.select(*keep, text).mapInArrow(run, docs.select(*keep).schema.add(ids, T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with ``decoded`` (binary) beside ``ids``: null for null, no bytes for no ids. An id that is no rank, or a null within an array, is an error.

    Bytes and not a string, since ids cut anywhere need not be whole characters.
    """
    small_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe(vocabulary(ranks))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("an array of ids holds a null")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            flat, bounds = model.texts_of(flat.to_numpy(), np.append(0, np.cumsum(sizes, dtype=np.int64)))
            own = binaries(flat, bounds)
            if column.null_count:
                own = pc.if_else(column.is_valid(), own, None)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), own], names=[*keep, decoded])

    return rows.select(*keep).mapInArrow(run, rows.select(*keep).schema.add(decoded, "binary"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``, and the texts that come back from them."""
    rows = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
