"""Ids of whole texts from a public tokenizer file, in tasks that Spark partitions.

A text is cut where the tokenizer never joins the two sides (before white space, and between a letter and an ASCII
character that is none, as both tokenizers end a run of letters there), so a word is one piece whatever follows it. Each
distinct piece is encoded once by the tokenizers library and then looked up by a 64-bit hash of its bytes (two pieces
share one with probability 2**-64). Most pieces of a byte-level tokenizer are letters after one space or none, which its
pattern leaves together, so they go to the library's model without the pattern, its most expensive part. The look-up
table of a worker is emptied when it holds ``PIECES`` pieces. Texts that hold a special token of the tokenizer as text,
in any case, or rare white space are encoded whole by the library.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from . import words

#: Pieces that a worker remembers at most.
PIECES = 500_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII that is neither a letter nor white space.
_MARK = words.KINDS["spaced"] & ~_LETTER
_MARK[128:] = False

#: First bytes of U+00C0 to U+027F and U+0400 to U+047F, letters but for those below.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xCA] = _LEAD[0xD0:0xD2] = True
#: Signs of multiplication and division, and the one letter that is two characters in lower case.
_NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))

#: The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one of those from U+0100.
_SEEN = np.zeros(256, dtype=bool)
_SEEN[33:127] = _SEEN[161:173] = _SEEN[174:] = True
_CHARACTER = np.where(_SEEN, np.arange(256), 255 + np.cumsum(~_SEEN)).astype("<u2")

_coders: dict[tuple[str, bool], Coder] = {}


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters, of ASCII and of ``_LEAD``; other letters are left out."""
    lead = _LEAD[data]
    for a, b in _NO_LETTERS:
        lead[:-1] &= (data[:-1] != a) | (data[1:] != b)
    out = _LETTER[data] | lead
    out[1:] |= lead[:-1]
    return out


def _other_spaces(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    found = []
    at = np.flatnonzero(data[:-1] == 0xC2)
    found.append(at[np.isin(data[at + 1], (0x85, 0xA0))])
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else at[:0]
    a, b, c = data[at], data[at + 1], data[at + 2] if len(at) else data[:0]
    wide = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | np.isin(c, (0xA8, 0xA9, 0xAF)))
    found.append(at[wide | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))])
    return np.concatenate(found)


def _spelled(data: np.ndarray, token: bytes) -> np.ndarray:
    """Places of a lower-case token, A-Z lowered."""
    n = len(token)
    if len(data) < n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words.lowered(data[: len(data) - n + 1]) == token[0])
    for i in range(1, n):
        at = at[words.lowered(data[at + i]) == token[i]]
    return at


class Coder:
    """``byte_level``: white space belongs to the pieces, each a run of it and what follows; else the tokenizer lowers and drops it."""

    def __init__(self, path: str, byte_level: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.model.get_added_tokens_decoder().values()]
        self.byte_level = byte_level
        self.words = self.model.model if byte_level and self._by_letters() else None
        self._forget()

    def _by_letters(self) -> bool:
        """Whether letters after one space or none are one word to the pattern, and the model alone then gives the ids."""
        from tokenizers import models, pre_tokenizers

        cut, model = self.model.pre_tokenizer, self.model.model
        usual = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        return usual and isinstance(model, models.BPE) and not model.dropout and self.model.normalizer is None and self.model.truncation is None and self.model.padding is None

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.begin, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.used = 0

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> list[list[int]]:
        """The ids of pieces; ``plain`` ones are letters after one space or none."""
        out: list[list[int]] = [[]] * len(starts)
        if plain.any():
            size = (ends - starts)[plain]
            end = np.cumsum(size)
            at = np.repeat(starts[plain] - end + size, size) + np.arange(int(end[-1]))
            text, model = _CHARACTER[data[at]].tobytes().decode("utf-16-le"), self.words
            for i, a, b in zip(np.flatnonzero(plain).tolist(), (end - size).tolist(), end.tolist(), strict=True):
                out[i] = [t.id for t in model.tokenize(text[a:b])]
        rest = np.flatnonzero(~plain).tolist()
        pieces = [data[starts[i] : ends[i]].tobytes().decode() for i in rest]
        for i, e in zip(rest, self.model.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        """New pieces with their sorted keys."""
        n = len(self.keys)
        for lo in range(0, len(keys), 20_000):
            chunk = slice(lo, lo + 20_000)
            ids = self._ids(data, starts[chunk], ends[chunk], plain[chunk])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            a, b, end = n + lo, n + lo + len(ids), self.used + int(size.sum())
            while end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while b > len(self.begin):
                self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
            self.flat[self.used : end] = np.fromiter(chain.from_iterable(ids), np.uint32, end - self.used)
            self.size[a:b] = size
            self.begin[a:b] = self.used + np.cumsum(size) - size
            self.used = end
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.place = np.insert(self.place, at, np.arange(n, n + len(keys)))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice (see :func:`.words.slices`), each followed by ``end_id``, and how many each has."""
        if len(self.keys) > PIECES:
            self._forget()
        letter = _letters(data)
        after = np.flatnonzero(_MARK[data[1:]] & letter[:-1]) + 1
        after = after[~np.isin(after, offsets)]  # the first of a text begins a piece anyway
        if self.byte_level:
            space = ~words.KINDS["spaced"][data]
            begins = space.copy()
            begins[1:] &= ~space[:-1]
            begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
            begins[after] = True
            lone = np.flatnonzero(begins[:-1] & space[:-1] & (data[:-1] != 32) & letter[1:]) + 1  # one line end, say, and letters: two words to the pattern
            begins[lone] = True
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            first = np.searchsorted(starts, offsets)
        else:
            starts, ends, first = words.bounds(data, offsets, "spaced")
            starts, ends = np.sort(np.concatenate([starts, after]), kind="stable"), np.sort(np.concatenate([ends, after]), kind="stable")
            first = np.searchsorted(starts, offsets)
        h, index, back = np.unique(words.hashes(data, starts, ends, lower=not self.byte_level), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != h) if len(self.keys) else np.arange(len(h))
        if len(new):
            plain = np.zeros(len(new), dtype=bool)
            if self.words is not None:  # its pieces are all the bytes; all but one space before them are letters
                spaced = data[starts] == 32
                plain = ((np.add.reduceat(~letter, starts, dtype=np.int64) == spaced) & (ends - starts > spaced))[index[new]]
            self._learn(h[new], data, starts[index[new]], ends[index[new]], plain)
            at = np.searchsorted(self.keys, h)
        piece = self.place[at][back] if len(h) else np.zeros(0, dtype=np.int64)
        size = self.size[piece]
        odd: dict[int, list[int]] = {}
        strange = [_spelled(data, t) for t in self.special]
        if self.byte_level and len(data) > 1:  # spaces of both kinds can be one piece
            strange.append(_other_spaces(data))
        if len(strange := np.concatenate(strange)):
            for row in np.unique(np.searchsorted(offsets, strange, side="right") - 1).tolist():
                odd[row] = self.model.encode(data[offsets[row] : offsets[row + 1]].tobytes().decode(), add_special_tokens=False).ids
                size[first[row] : first[row + 1]] = 0
        total = np.concatenate([[0], np.cumsum(size)])
        body = total[first[1:]] - total[first[:-1]]
        count = body + 1
        for row, ids in odd.items():
            count[row] += len(ids)
        out = np.empty(int(count.sum()), dtype=np.uint32)
        start = np.cumsum(count) - count
        gather = np.repeat(self.begin[piece] - total[:-1], size) + np.arange(int(total[-1]))
        out[np.repeat(start - (np.cumsum(body) - body), body) + np.arange(len(gather))] = self.flat[gather]
        for row, ids in odd.items():
            out[start[row] : start[row] + len(ids)] = ids
        out[start + count - 1] = end_id
        return out, count


def coder(path: str, byte_level: bool) -> Coder:
    """One for each worker process."""
    if (path, byte_level) not in _coders:
        _coders[path, byte_level] = Coder(path, byte_level)
    return _coders[path, byte_level]
