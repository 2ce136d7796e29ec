"""Token ids of texts, many at once, of which each unlike word is encoded once.

``Encoder(path)`` reads a ``tokenizers`` .json (or a ``sentencepiece`` .model).
For two byte-level BPE layouts texts are cut at places where every match of the
pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

ends and another begins, whatever else stands in the text, so ids of a whole
text are those of its pieces. Only characters of a known class count; there is
no cut beside any other, so none where a normal form may compose. Such places are

* between letters, digits and marks: a run of one of them is never left before
  its end. An apostrophe and a letter stay together, as they may be one match;
* behind such a visible character, before an ASCII white space;
* before the last white space in front of one, which ``\\s+(?!\\S)`` leaves, and
  behind it if it is no space, which then is a match by itself.

The other layout (``spaced`` false) lower-cases, drops white space and takes
digits one by one: it is cut there too, and between digits. Nearly all pieces
are one match, which the library's model gets without the library's search for
matches. Arrow tells pieces apart and puts their ids together. Ids of short
pieces are kept. Other files, and texts with added tokens in them, go to the
library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Characters whose class is the same in every Unicode version at hand, and those of them that are letters.
PLAIN = r"\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ſЀ-џ‐-―‘-‟…€"
LETTERS = "".join(c for c in map(chr, range(0x530)) if c.isalpha() and re.match(f"[{PLAIN}]", c))
#: Bytes of text whose pieces are told apart together.
TOGETHER = 8 << 20
#: Pieces whose ids a worker keeps, and bytes of a kept one at most. When there are more, those that the last texts did not have are forgotten.
CACHE_PIECES, CACHE_BYTES = 600_000, 48
_CUT = re.compile(r"(?<=[!-~])(?=[ \n])")
#: Classes of bytes.
OTHER, SPACE, BREAK, LETTER, DIGIT, MARK, QUOTE = range(7)
_CLASS = np.array([LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else QUOTE if b == 39 else MARK if 32 < b < 127 else SPACE if b == 32 else BREAK if b in b"\t\n\r" else OTHER for b in range(128)] + [OTHER] * 128, np.uint8)
_TWO_BYTES = np.zeros(1 << 16, bool)
_TWO_BYTES[[int.from_bytes(c.encode()) for c in LETTERS if c > "\x7f"]] = True


def _between(spaced: bool) -> np.ndarray:
    """Whether there is a cut between two bytes of these classes, at 8 * the first + the second."""
    kind = {LETTER: 1, DIGIT: 2, MARK: 3, QUOTE: 3}
    cut = np.zeros(64, bool)
    for a in range(7):
        for b in range(7):
            if a in kind and b in kind:
                cut[8 * a + b] = kind[a] != kind[b] and (a, b) != (QUOTE, LETTER) or a == b == DIGIT and not spaced
            else:
                cut[8 * a + b] = a in kind and b in (SPACE, BREAK) or a == BREAK and b in kind
    return cut


_BETWEEN = {s: _between(s) for s in (False, True)}


def classes(flat: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of a letter have its class."""
    found = _CLASS[flat]
    at = np.flatnonzero(flat >= 0xC2)
    if len(at):
        at = at[_TWO_BYTES[flat[at].astype(np.int32) << 8 | flat[at + 1]]]
        found[at] = found[at + 1] = LETTER
    return found


def cuts(flat: np.ndarray, starts: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pieces begin in texts that stand one behind another, none of them empty."""
    kind = classes(flat)
    last = (kind[:-1] - SPACE < 2) & (kind[1:] > BREAK)  # unsigned, so 0 is not below
    last[starts[1:] - 1] = False
    cut = np.empty(len(flat), bool)
    cut[1:] = _BETWEEN[spaced][kind[:-1] << 3 | kind[1:]]
    cut[:-1] |= last
    cut[starts] = True
    return np.flatnonzero(cut)


def single(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which pieces are one match (or white space that is dropped): those without other characters and without a letter behind an apostrophe."""
    kind = classes(flat)
    bad = kind == OTHER
    bad[1:] |= (kind[:-1] == QUOTE) & (kind[1:] == LETTER)
    bad[bounds[:-1]] = kind[bounds[:-1]] == OTHER
    before = np.append(0, np.cumsum(bad, dtype=np.int32))
    return before[bounds[1:]] == before[bounds[:-1]]


def parts_of(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings or binaries one behind another, and the bounds of each."""
    if not len(found):
        return np.empty(0, np.uint8), np.zeros(1, np.int32)
    _, at, data = found.buffers()
    bounds = np.frombuffer(at, np.int32)[found.offset : found.offset + len(found) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def binaries(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The other way round."""
    return pa.Array.from_buffers(kind or pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def byte_characters() -> str:
    """256 visible characters, one a byte: a byte that is one in Latin-1 stands for itself, the others are numbered from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(others)) for b in range(256))


class ByteLetters:
    """One visible character for each byte, as byte-level vocabularies write them; without white space if that is dropped."""

    def __init__(self, letters: str, spaced: bool):
        self.bytes = np.zeros((257, 2), np.uint8)  # the last row ends a piece
        self.some = np.zeros((257, 2), bool)
        for b, c in enumerate([*letters, "\n"]):
            if spaced or b == 256 or _CLASS[b] not in (SPACE, BREAK):
                own = c.encode()
                self.bytes[b, : len(own)], self.some[b, : len(own)] = list(own), True

    def strung(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[str, np.ndarray]:
        """The pieces as lines, and how many characters there are up to the end of each, without the ends of lines."""
        ended = np.insert(flat.astype(np.uint16), bounds[1:], 256)
        text = self.bytes[ended][self.some[ended]].tobytes().decode()
        return text[:-1], np.cumsum(self.some[:256, 0][flat])[bounds[1:] - 1]


class Words:
    """Base of an encoder: the ids of whole texts, from those that ``_new`` gives for pieces."""

    spaced = True

    def __init__(self):
        self.kept, self.kept_ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _new(self, pieces: pa.Array) -> pa.Array:
        """The packed ids of each piece."""
        raise NotImplementedError

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text; long ones are cut where white space follows a visible character."""
        out: list[bytes] = [b""] * len(texts)
        group: list[tuple[int, bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                m = _CUT.search(text, at + TOGETHER) if len(text) - at > TOGETHER else None
                to = m.start() if m else len(text)
                group.append((i, (text if to - at == len(text) else text[at:to]).encode()))
                held, at = held + len(group[-1][1]), to
                if held >= TOGETHER:
                    self._settle(group, out)
                    group, held = [], 0
        if group:
            self._settle(group, out)
        return out

    def _settle(self, group: list[tuple[int, bytes]], out: list[bytes]) -> None:
        for (i, _), ids in zip(group, self._together([d for _, d in group])):
            out[i] = out[i] + ids if out[i] else ids

    def _together(self, data: list[bytes]) -> list[bytes]:
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        starts = np.append(0, ends[:-1])
        flat = np.frombuffer(b"".join(data), np.uint8)
        at = cuts(flat, starts, self.spaced)
        pieces = binaries(flat, np.append(at, len(flat)), pa.string())
        told = pa.chunked_array([self.kept, pieces]).dictionary_encode()
        which, words = told.chunks[-1].indices, told.chunks[-1].dictionary  # those that are kept come first
        ids = self.kept_ids
        if len(words) > len(self.kept):
            ids = pa.concat_arrays([ids, self._new(words.slice(len(self.kept)))])
        self._keep(words, ids, which)
        packed, bounds = parts_of(ids.take(which))
        packed, bounds = packed.tobytes(), bounds[np.append(np.searchsorted(at, starts), len(at))].tolist()
        return [packed[x:y] for x, y in zip(bounds, bounds[1:])]

    def _keep(self, words: pa.Array, ids: pa.Array, which: pa.Array) -> None:
        some = np.diff(parts_of(words)[1]) <= CACHE_BYTES
        if len(words) > CACHE_PIECES:
            some &= np.bincount(which.to_numpy(), minlength=len(words)) > 0
        some = pa.array(np.flatnonzero(some)[:CACHE_PIECES])
        self.kept, self.kept_ids = words.take(some), ids.take(some)


def in_order(one: np.ndarray, whole: pa.Array, others: pa.Array) -> pa.Array:
    """Ids in the order of pieces: those of which ``one`` is true, and the others."""
    if not len(others):
        return whole
    place = np.empty(len(one), np.int64)
    place[one], place[~one] = np.arange(len(whole)), len(whole) + np.arange(len(others))
    return pa.concat_arrays([whole, others]).take(pa.array(place))


def grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches that hold about ``TOGETHER`` bytes in a column."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def packed_batches(packed_all: Callable[[list[str]], list[bytes]], batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the ids of its texts in a column (null: empty), which are made for several batches at once."""
    for own in grouped(batches, column):
        ids, at = packed_all([t or "" for b in own for t in b.column(column).to_pylist()]), 0
        for b in own:
            yield b, ids[at : at + len(b)]
            at += len(b)


#: The pattern of the byte-level step where the file does not name one, and the steps and the pattern where it does.
BYTE_LEVEL = ["ByteLevel"]
SPLIT_LEVEL, NORMALIZED = ["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CACHED: dict[str, "Encoder"] = {}


class Encoder(Words):
    """``ids(text)`` of one tokenizer file, without begin, end or added special tokens; special strings inside texts are handled as the library does."""

    def __init__(self, path: str, cut: bool = True):
        super().__init__()
        self.path, self.kind = path, "sentencepiece" if path.endswith(".model") else "tokenizers"
        self.cuts = False
        if self.kind == "sentencepiece":
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.lib.get_piece_size()
        else:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            self.size = self.lib.get_vocab_size()
            self.lib.no_truncation()
            self.lib.no_padding()
            if cut:
                with open(path, encoding="utf-8") as f:
                    self._look(json.load(f))
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def _look(self, spec: dict) -> None:
        """Whether this file's texts may be cut, and if so, the model alone and how many bytes of a match each token is."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps, added = pre.get("pretokenizers", [pre]), spec.get("added_tokens", [])
        end = model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or end not in ("", "</w>") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            return
        kinds, held = [s.get("type") for s in steps], self.lib.get_vocab(with_added_tokens=False)
        if any(s.get("add_prefix_space") for s in steps) or not held.keys() >= {c + e for c in ByteLevel.alphabet() for e in {"", end}}:
            return
        if kinds == BYTE_LEVEL and steps[0]["use_regex"] and norm is None:
            self.cuts = self.spaced = True
        elif kinds == SPLIT_LEVEL and steps[0].get("invert") and not steps[1]["use_regex"] and norm and [n["type"] for n in norm.get("normalizers", [])] == NORMALIZED and norm["normalizers"][1]["pattern"].get("Regex") == r"\s+" and steps[0]["pattern"].get("Regex") == SPLIT:
            self.cuts, self.spaced = True, False
        if self.cuts:
            self.added = [t["content"] for t in added]
            self.letters = ByteLetters(byte_characters(), self.spaced)
            self.matcher = Tokenizer(self.lib.model)
            self.matcher.pre_tokenizer = CharDelimiterSplit("\n")
            # no byte is left out, so the tokens of a match cover it
            self.bytes_of = np.zeros(1 + max(held.values()), np.int64)
            self.bytes_of[list(held.values())] = [len(t) - len(end) * t.endswith(end) for t in held]

    def _library(self, text: str) -> bytes:
        ids = self.lib.encode(text, num_threads=1) if self.kind == "sentencepiece" else self.lib.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _new(self, pieces: pa.Array) -> pa.Array:
        """Single matches go to the library's model in one call, and the lengths of tokens tell which are whose; the others go to the library."""
        one = single(*parts_of(pieces))
        flat, bounds = parts_of(pieces.filter(pa.array(one)))
        if not self.spaced and len(flat):  # no letter at hand changes its length
            flat = np.frombuffer(flat.tobytes().decode().lower().encode(), np.uint8)
        text, ends = self.letters.strung(flat, bounds)
        got = np.array(self.matcher.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], self.dtype)
        cuts = np.append(0, np.searchsorted(np.cumsum(self.bytes_of[got]), ends, "right"))
        others = pieces.filter(pa.array(~one)).to_pylist()
        return in_order(one, binaries(got, self.dtype.itemsize * cuts), pa.array([np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(others, add_special_tokens=False)] if others else [], pa.binary()))

    def packed(self, text: str) -> bytes:
        """The ids of the whole text, packed as ``dtype``."""
        return self.packed_all([text])[0]

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """``packed`` of each text."""
        whole = [i for i, t in enumerate(texts) if not self.cuts or any(a in t for a in self.added)]
        if not whole:
            return super().packed_all(texts)
        asked = set(whole)
        out = super().packed_all(["" if i in asked else t for i, t in enumerate(texts)])
        for i in whole:
            out[i] = self._library(texts[i])
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype=self.dtype)

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, id) of each token of a text, in code points, as the library has them."""
        if self.kind != "tokenizers":
            raise ValueError("offsets are read from the tokenizers library only")
        e = self.lib.encode(text, add_special_tokens=False)
        for i, (a, b) in zip(e.ids, e.offsets):
            yield a, b, i


def encoder(path: str) -> Encoder:
    """One encoder a worker and file; Python workers are used again by later tasks."""
    if path not in _CACHED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _CACHED[path] = Encoder(path)
    return _CACHED[path]


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine: the path of the installed files, or ``name`` itself if it is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
