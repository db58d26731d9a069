"""Splitting many texts into the words of a public byte-pair tokenizer at once, and encoding distinct words.

The vectorised split follows the two patterns below. Texts that it cannot judge (a special token's string, code points
that this Python does not know) are left to the tokenizers library whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from corvane.llm.segments import LETTER, NUMBER, OTHER, SPACE, UNASSIGNED, classes, code_points, segment_hashes

#: The endings that both patterns split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHED_WORDS = 400_000  # of a worker; a slice of texts with more distinct words holds its own only
SPECIALS = ("<|endoftext|>", "<|startoftext|>")


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def odd(text: str) -> bool:
    """Whether the vectorised split cannot judge the text."""
    return ("<|" in text and any(s in text for s in SPECIALS)) or (not text.isascii() and bool((classes()[code_points([text])[0]] == UNASSIGNED).any()))


def lowered(text: str) -> str:
    """NFC, then lower case one code point at a time: a final sigma is not told apart."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def split(codes: np.ndarray, bounds: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts codes[bounds[i]:bounds[i + 1]], in order.

    spaced: a word takes one blank before it, white space is kept and numbers stay whole; otherwise white space goes
    and each number character is a word."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[codes]
    text_start = np.zeros(len(codes) + 1, bool)
    text_start[bounds] = True
    cut = text_start[:-1].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    if not spaced:
        cut |= kind == NUMBER
    starts = np.flatnonzero(cut).astype(np.int64)
    ends = np.append(starts[1:], len(codes))
    of = kind[starts]
    before = np.where(starts > 0, codes[starts - 1], 0)
    attached = (of != SPACE) & ~text_start[starts] & (before == 32) & spaced
    # An apostrophe alone, without a blank attached, takes one of the endings from the letters that follow.
    tick = np.flatnonzero((codes[starts] == 39) & (ends - starts == 1) & ~attached & (of == OTHER))
    tick = tick[tick + 1 < len(starts)]
    tick = tick[(of[tick + 1] == LETTER) & ~text_start[starts[tick + 1]]]
    if len(tick):
        first = starts[tick + 1]
        longest = ends[tick + 1] - first
        a = codes[first]
        b = np.where(longest > 1, codes[np.minimum(first + 1, len(codes) - 1)], 0)
        size = np.zeros(len(tick), np.int64)
        for ending in ENDINGS:
            fits = (a == ord(ending[0])) & ((b == ord(ending[1])) if len(ending) > 1 else True)
            size[(size == 0) & fits] = len(ending)
        ends[tick] += size
        starts[tick + 1] += size
    starts = starts - attached
    if spaced:
        # White space before a word: its last character is the word's blank, or else stands alone.
        space = of == SPACE
        followed = space & np.append(~text_start[ends[:-1]], False)
        last = ends - 1
        alone = followed & (codes[last] != 32)
        ends = np.where(followed, last, ends)
        starts, ends = np.concatenate([starts, last[alone]]), np.concatenate([ends, last[alone] + 1])
        order = np.argsort(starts, kind="stable")
        full = ends[order] > starts[order]
        return starts[order][full], ends[order][full]
    full = (of != SPACE) & (ends > starts)
    return starts[full], ends[full]


def distinct_words(texts: list[str], spaced: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of the word at each position, bounds of each text's positions).

    Words are told apart by a 64-bit hash of their code points."""
    codes, bounds = code_points(texts)
    starts, ends = split(codes, bounds, spaced)
    _, first, inverse = np.unique(segment_hashes(codes, starts, ends), return_index=True, return_inverse=True)
    joined = "".join(texts)
    words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    return words, inverse.astype(np.int32), np.searchsorted(starts, bounds)


def gather(inverse: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the words at all positions, one after the other, and where each position's begin."""
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    n = sizes[inverse]
    at = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(begins[inverse] - at[:-1], n) + np.arange(at[-1])], at


def encode_words(path: str, words: list[str]) -> list[list[int]]:
    """In small batches: the library's results are far larger than the ids in them. Offsets are not asked for."""
    found = tokenizer(path)
    return [e.ids for at in range(0, len(words), 1000) for e in found.encode_batch_fast(words[at : at + 1000], add_special_tokens=False)]


@lru_cache(1)
def closes_word(path: str) -> np.ndarray:
    """By id, whether a piece ends a word."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
    return out


def encode_parted(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words one after the other, how many each has), for a tokenizer that drops white space and marks the
    ends of words: a line of many words costs the library less than as many lines."""
    found, ends, ids, sizes = tokenizer(path), closes_word(path), [], []
    for at in range(0, len(words), 1000):
        part = words[at : at + 1000]
        got = np.array(found.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
        last = np.flatnonzero(ends[got])
        if len(last) == len(part) and last[-1] == len(got) - 1:
            size = np.diff(last, prepend=-1)
        else:
            each = encode_words(path, part)
            size = np.fromiter(map(len, each), np.int64, len(each))
            got = np.fromiter((i for one in each for i in one), np.int64, int(size.sum()))
        ids.append(got), sizes.append(size)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + ids).astype(np.uint32), np.concatenate(none + sizes)


class Encoder:
    """Encodes whole texts by the lower-casing word tokenizer; a distinct word is encoded once while the worker holds it."""

    def __init__(self, path: str):
        self.path = path
        self.keys, self.begin, self.size, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is held; what stands there may be another."""
        return np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))

    def _hold(self, keys: np.ndarray, words: list[str]) -> None:
        ids, size = encode_parted(self.path, words)
        begin = np.cumsum(size) - size + len(self.values)
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.begin, self.size = (np.concatenate(c)[order] for c in ((self.keys, keys), (self.begin, begin), (self.size, size)))
        self.values = np.concatenate([self.values, ids])

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where those of each text begin, the end included)."""
        texts_low = [lowered(t) for t in texts]
        # The library normalises before it lower-cases, and its words here once more: where lower case undoes the first, texts go whole.
        plain = [not odd(t) and (low.isascii() or unicodedata.is_normalized("NFC", low)) for t, low in zip(texts, texts_low)]
        texts_low = [low if p else "" for low, p in zip(texts_low, plain)]
        codes, bounds = code_points(texts_low)
        starts, ends = split(codes, bounds, spaced=False)
        keys, first, inverse = np.unique(segment_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[self._places(keys)] != keys
        if len(self.keys) + new.sum() > CACHED_WORDS:
            self.__init__(self.path)
            new[:] = True
        if new.any():
            joined = "".join(texts_low)
            self._hold(keys[new], [joined[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        place = self._places(keys)[inverse] if len(keys) else np.zeros(0, np.int64)
        size = self.size[place]
        at = np.concatenate([[0], np.cumsum(size)])
        values = self.values[np.repeat(self.begin[place] - at[:-1], size) + np.arange(at[-1])]
        cuts = at[np.searchsorted(starts, bounds)]
        if all(plain):
            return values, cuts
        parts = [values[a:b] if p else np.array(encode_words(self.path, [t])[0], np.uint32) for t, p, a, b in zip(texts, plain, cuts, cuts[1:])]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        values, cuts = self.flat(texts)
        return [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
