"""Exact ids and counts of whole texts for a byte-level BPE file, word by word.

A text is cut before each space that is the first or the last character of its run of
white space; the pre-tokenizer never joins what stands on two sides of such a place, so
words encode alone and their ids can be kept. Texts where a cut would fall inside a run of
white space, or that hold a special token's text, go to the library whole.
"""

from __future__ import annotations

import functools
import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# White space of the pre-tokenizer's pattern, for Arrow's regular expressions.
_SPACE = r"[\t\n\x{0b}\f\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INSIDE_RUN = f"{_SPACE} (?:{_SPACE}|\\z)"
# Marks that are a pre-token of their own after letters and at a word's end.
_STOPS = frozenset(".,;:!?")
# Words of at most ``KEPT_CHARS`` letters whose ids a worker keeps, about 80 MB, and whose counts.
# Other marks and digits vary what a word looks like; it is kept once, without them.
WORDS_KEPT = 400_000
COUNTS_KEPT = 800_000
KEPT_CHARS = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_texts(path: str) -> list[str]:
    return [token.content for token in tokenizer(path).get_added_tokens_decoder().values()]


def spelled(key: str) -> str:
    """What a key stands for: a word after a space, or, marked by a space, a text's first."""
    return key[1:] if key.startswith(" ") else " " + key


def ids_of(path: str, strings: list[str]) -> list[list[int]]:
    encoded = tokenizer(path).encode_batch_fast(strings, add_special_tokens=False)
    return [e.ids for e in encoded]


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary strings proven to encode, alone, as exactly their own one token, and its id."""
    letters = _byte_letters()
    strings = {}
    for token, number in tokenizer(path).get_vocab(with_added_tokens=False).items():
        try:
            strings[bytes(letters[c] for c in token).decode()] = number
        except (KeyError, UnicodeDecodeError):
            continue
    names = list(strings)
    return {s: strings[s] for s, ids in zip(names, ids_of(path, names)) if ids == [strings[s]]}


class _Words:
    """Finds the words of texts in what is kept; what is new is learnt from the library's
    merges. Words are kept up to a bound, then forgotten all at once."""

    nothing: object = None

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        import public_tokenizers

        self.path, self.words_kept = path, words_kept
        self.whole = whole_tokens(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special = "|".join(regex.escape(s, special_only=True) for s in special_texts(path))
        self.letters = str.maketrans({chr(b): letter for letter, b in _byte_letters().items()})
        self.space = self.letters[ord(" ")]
        self.merge = tokenizer(path).model.tokenize
        self.known: dict = {}

    def tokens(self, piece: str) -> list:
        """The library's tokens of one pre-token that is not a whole token itself."""
        if piece.isascii() and piece.isprintable():  # all but the space stand for themselves
            return self.merge(piece.replace(" ", self.space))
        return self.merge(piece.encode().decode("latin-1").translate(self.letters))

    def piece(self, piece: str):
        """What is kept of one pre-token."""
        raise NotImplementedError

    def letters_only(self, key: str):
        """What is kept of a word that is one pre-token of letters."""
        value = self.known.get(key)
        if value is None:
            value = self.piece(spelled(key))
            if len(key) <= KEPT_CHARS:
                self.known[key] = value
        return value

    def word(self, key: str):
        """What is kept of a word, from the pre-tokens it consists of."""
        if key.isalpha():
            return self.letters_only(key)
        if key[-1:] in _STOPS and key[:-1].isalpha():
            return self.letters_only(key[:-1]) + self.piece(key[-1])
        value = self.nothing
        for piece in self.split(spelled(key)):
            key = piece[1:] if piece[0] == " " else " " + piece
            value += self.letters_only(key) if key.lstrip(" ").isalpha() else self.piece(piece)
        return value

    def find(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """What is kept of each different word, the number of each word of all texts, where
        each text's words begin, with the total at the end, and which texts have no words
        here but go to the library whole."""
        if len(self.known) > self.words_kept:
            self.known.clear()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        pattern = f"{_INSIDE_RUN}|{self.special}" if self.special else _INSIDE_RUN
        whole = pc.match_substring_regex(texts, pattern)
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        coded = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes eight times as long
        numbers = coded.indices.to_numpy().copy()
        heads, inverse = np.unique(numbers[bounds[:-1]], return_inverse=True)
        numbers[bounds[:-1]] = len(keys) + inverse
        keys += [" " + keys[i] for i in heads]
        kept, word = self.known.get, self.word
        values = [v if (v := kept(k)) is not None else word(k) for k in keys]
        return values, numbers, bounds, whole.to_numpy(zero_copy_only=False)


class Encoder(_Words):
    """Ids of texts."""

    nothing = b""

    def piece(self, piece: str) -> bytes:
        number = self.whole.get(piece)
        if number is not None:
            return number.to_bytes(4, "little")
        ids = [t.id for t in self.tokens(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        values, numbers, bounds, whole = self.find(texts)
        flat = np.frombuffer(b"".join(values), "<u4")
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begin = (np.cumsum(lengths) - lengths).astype(np.int32)[numbers]
        lengths = lengths.astype(np.int32)[numbers]
        after = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        shift = begin - after[:-1].astype(np.int32)
        ids = flat[np.repeat(shift, lengths) + np.arange(after[-1], dtype=np.int32)]
        bounds = after[bounds]
        counts = np.diff(bounds)
        if not whole.any():
            return ids, counts
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        rows = np.flatnonzero(whole)
        for i, found in zip(rows, ids_of(self.path, texts.take(pa.array(rows)).to_pylist())):
            parts[i] = np.array(found, np.uint32)
            counts[i] = len(found)
        return np.concatenate(parts), counts


class Counter(_Words):
    """Number of tokens of texts: pre-tokens that are whole tokens count one, only the
    rest is merged."""

    nothing = 0

    def piece(self, piece: str) -> int:
        return 1 if piece in self.whole else len(self.tokens(piece))

    def count(self, texts: pa.Array) -> np.ndarray:
        values, numbers, bounds, whole = self.find(texts)
        counts = np.fromiter(values, np.int64, len(values))[numbers]
        totals = np.diff(np.r_[0, np.cumsum(counts)][bounds])
        rows = np.flatnonzero(whole)
        if len(rows):
            totals[rows] = [len(ids) for ids in ids_of(self.path, texts.take(pa.array(rows)).to_pylist())]
        return totals


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process; what it has learnt serves the next tasks too."""
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path, COUNTS_KEPT)
